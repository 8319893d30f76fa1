"""Empty tables, and extra columns whose names the operators use themselves."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, SCHEMA

from tokenizers import Tokenizer

from changeset.llm import chat, common, decontaminate, lang_id, license_scan, mixing, near_dedup, quality, queries, substring_dedup, token_count, url_filter

NAMES = ["td", "id", "sd", "n", "sketch", "key", "root", "comp", "content", "n_tokens", "n_bytes", "p", "topic", "draw", "sampled", "kept", "n_words", "window", "starts", "copies", "least", "start", "item_id", "lang_pred", "score", "held_out", "spans", "labels"]
DOCS = {
    "decontaminate": lambda d: decontaminate.contaminated(d, d.select(F.lit(1).alias("item_id"), "text", F.lit("x").alias("h"))),
    "near": near_dedup.classes,
    "tokens": lambda d: token_count.count_tokens(d, public_tokenizers.path(queries.TOKENIZER)),
    "lang": lang_id.identify,
    "license": license_scan.scan_licenses,
    "mix": mixing.mix,
    "quality": lambda d: quality.judge_documents(d, ["doc_id"]),
    "substrings": lambda d: substring_dedup.dedup_substrings(d, text=False),
}


@pytest.mark.parametrize("name", sorted(DOCS))
def test_documents(spark, name):
    docs = spark.createDataFrame(ODD, SCHEMA)
    clashing = docs.select("*", *[F.lit("clash").alias(n) for n in NAMES if n not in docs.columns])
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(DOCS[name](clashing)) == shown(DOCS[name](docs))
    assert DOCS[name](docs.where("false")).count() == 0
    assert DOCS[name](clashing.where("false")).count() == 0


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "<p>"), (1, "http://a.net/x", "<p>"), (None, None, None)], "page_id long, url string, html string")
    clash = pages.select("*", *[F.lit("c").alias(n) for n in ("host", "path", "node", "fit", "rule", "verdict", "group", "allowed")])
    judge = lambda p: sorted(map(str, url_filter.judge_urls(p, queries.URL_RULES).collect()))
    assert judge(clash) == judge(pages) and len(judge(pages)) == 3
    turns = spark.createDataFrame([(1, 0, "ann", "a"), (1, 1, "bob", "b")], "conv_id long, turn long, role string, text string")
    clash = turns.select("*", *[F.lit("c").alias(n) for n in ("perspective", "part", "says", "starts", "rendered", "spans", "head", "mine")])
    shown = lambda t: sorted(map(str, chat.rotate_perspectives(t).collect()))
    assert shown(clash) == shown(turns) and len(shown(turns)) == 2
    assert chat.rotate_perspectives(turns.where("false")).count() == 0


def test_names_handed_on(spark):
    """A column to hand on may have any name but the result's own."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    names = ["td", "id", "spans", "copies", "row", "text", "least"]
    own = docs.select("doc_id", "text", *[F.lit(n).alias(n) for n in names if n != "text"])
    for made in (substring_dedup.dedup_substrings(own, keep=names), quality.judge_documents(own, ["doc_id", *[n for n in names if n != "text"]]), mixing.mix(own.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), keep=names)):
        rows = made.collect()
        assert len(rows) == len(ODD) and all(r[n] == n for r in rows for n in names if n in r.asDict() and n != "text")
    for wrong in (lambda: substring_dedup.dedup_substrings(docs, keep=["n_words"]), lambda: quality.judge_documents(docs, ["kept"]), lambda: mixing.mix(docs, keep=["p"])):
        with pytest.raises(ValueError):
            wrong()


def test_texts_beyond_a_chunk(spark):
    """Texts longer than what is hashed or cut at once, alike but for their ends, beside short ones."""
    words = [f"w{i * 7919 % 100_003}" for i in range(460_000)]
    long = " ".join(words)
    assert len(long) > 6 * common.CHUNK_WORDS > common.SEGMENT
    other = " ".join(["first", *words[:-40], *[f"new{i}" for i in range(40)]])
    rows = [(1, long, "en", "a"), (2, other, "en", "a"), (3, "a short one.", "en", "b"), (4, " ".join(words[1000:1040]), "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in near_dedup.classes(docs).collect()}
    assert [got[k]["component_id"] for k in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[1]["n_shingles"] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(docs).collect()}
    repeats = len(words) - 100_003 * 4 > 35  # the words go round
    assert repeats and cut == {1: (460_000, 460_000), 2: (460_001, 459_960), 3: (3, 0), 4: (40, 40)}
    assert {r["doc_id"]: r["n_words"] for r in license_scan.scan_licenses(docs).collect()}[2] == 460_001
    assert {r["doc_id"]: r["n_words"] for r in quality.judge_documents(docs, ["doc_id"]).collect()}[1] == 460_000
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.mix(docs).collect()}[2] == 460_001
    path = public_tokenizers.path(queries.TOKENIZER)
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(docs, path).collect()} == {d: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for d, t, _, _ in rows}
    item = spark.createDataFrame([(1, " ".join(words[300_000:300_060]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, item).collect()} == {1, 2}
    assert {r["lang_pred"] for r in lang_id.identify(docs).collect()} <= {"en", "und"}
