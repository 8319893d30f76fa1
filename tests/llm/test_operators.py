"""The operators against brute force, on the small tables and on odd rows."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changeset.llm import chat, common, decontaminate, graph, lang_id, license_scan, mixing, near_dedup, quality, queries, substring_dedup, token_count, url_filter
from changeset.llm.graph import connected_components

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, words string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000)) + "."
ODD = [
    (1, None, None, None, 0, "x", "x"),
    (2, "", "en", "a", 0, "x", "x"),
    (3, " \n\t ", "en", "a", 0, "x", "x"),
    (None, "some words without an id.", "en", None, 0, "x", "x"),
    (5, "a", "en", "a", 0, "x", "x"),
    (6, "same text here, five words and more of them.", "en", "a", 0, "x", "x"),
    (6, "same text here, five words and more of them.", "en", "a", 0, "x", "x"),
    (7, "b " * 400, "fr", "b", 0, "x", "x"),
    (8, LONG, "en", "b", 0, "x", "x"),
    (9, "1234 5678 !!", "en", "b", 0, "x", "x"),
    (10, " ".join(f"q{i}" for i in range(40)) + " " + " ".join(f"r{i}" for i in range(50)), "de", "c", 0, "x", "x"),
    (11, "zz " + " ".join(f"r{i}" for i in range(50)) + " yy", "de", "c", 0, "x", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def shingle_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_classes(rows, size=4):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    met = {(i, j) for h in holders.values() for j in h for i in h if i < j}
    for i, j in met:
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)), d is not None and d == least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("which,size", [("docs", 4), ("odd", 4), ("docs", 5)])
def test_near_duplicates_match_brute_force(which, size, request):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in near_dedup.classes(df, size=size).collect()), key=str)
    assert got == brute_classes(rows, size)


@pytest.mark.parametrize("stars,block", [(2, 1500), (1, 1 << 17), (0, 1500)])
def test_near_duplicates_through_rounds(spark, monkeypatch, stars, block):
    """Chains of edits: neighbours are linked, ends are not; stars alone don't join them."""
    monkeypatch.setattr(near_dedup, "STARS", stars)
    monkeypatch.setattr(near_dedup, "BLOCK_HASHES", block)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7 if block < 9999 else 400)
    base = [f"k{i}" for i in range(120)]
    rows = []
    for g in range(3):
        words = [f"{g}{w}" for w in base]
        for step in range(25):
            words = [*words[: step * 4], f"{g}new{step}", *words[step * 4 + 1 :]]
            rows.append((g * 100 + step, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.classes(df, size=4).collect()), key=str)
    assert got == brute_classes(rows)


def chained(passages, holders=40, own=12):
    """Documents that each hold two passages, the one before and the one after it in a ring, and a few words of their own."""
    rng = np.random.default_rng(2)
    passage = [[f"p{i}w{j}" for j in range(40)] for i in range(passages)]
    rows = []
    for i in range(passages):
        for k in range(holders):
            mine = [f"d{x}" for x in rng.integers(0, 1 << 40, own)]
            rows.append((i * holders + k, " ".join([*passage[i], *mine, *passage[(i + 1) % passages]])))
    return rows


def test_near_duplicates_with_chained_passages(spark, monkeypatch):
    """Lists that share members aren't gathered: comparisons grow with the lists, not with the square of all they reach."""
    monkeypatch.setattr(near_dedup, "BLOCK_HASHES", 2000)
    made = []
    once = near_dedup._block_links
    work = lambda df: df.groupBy("key").count().selectExpr("sum(count * count) as n").first()["n"] or 0
    monkeypatch.setattr(near_dedup, "_block_links", lambda now, nodes, sets: made.append(work(now)) or once(now, nodes, sets))
    for passages in (6, 24):
        rows = chained(passages)
        got = sorted((tuple(r) for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()), key=str)
        assert got == brute_classes(rows)
    assert 0 < made[1] < 6 * made[0]


def test_sketch_estimates():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(120, int(n), replace=False)).astype(np.int64) for n in rng.integers(1, 100, 60)]
    k = near_dedup.KEEP
    sizes = np.array([min(len(s), k) for s in sets])
    rows = np.zeros((len(sets), k), np.int64)
    for i, s in enumerate(sets):
        rows[i, : sizes[i]] = s[:k]
    for s in sets:
        want = []
        for t in sets:
            u = sorted({*s[:k].tolist(), *t[:k].tolist()})[:k]
            want.append(len(set(u) & set(s[:k].tolist()) & set(t[:k].tolist())) / len(u))
        assert np.allclose(near_dedup._estimates(s[:k], rows, sizes), want)


def brute_substrings(rows, k=35):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + k]) for w in texts for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone |= set(range(i, i + k))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which,bucket", [("docs", 2000), ("docs", 1), ("odd", 2000), ("odd", 1)])
def test_substrings_match_brute_force(which, bucket, request):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substring_dedup.dedup_substrings(df, bucket=bucket, text=False).collect()), key=str)
    assert got == brute_substrings(rows)


def test_substrings_with_a_passage_in_a_third_of_all_texts(spark, monkeypatch):
    """Crowded minimisers are cut again by longer ones; edited copies of the passage share parts of it."""
    rng = np.random.default_rng(5)
    passage, rows = [f"p{i}" for i in range(60)], []
    for d in range(180):
        own = [f"w{x}" for x in rng.integers(0, 4000, 70)]
        if d % 3 == 0:
            part = list(passage)
            if d % 2:
                part[int(rng.integers(0, 60))] = f"edit{d % 4}"
            at = int(rng.integers(0, 70))
            own = [*own[:at], *part, *own[at:]]
        rows.append((d, " ".join(own)))
    rows += [(500, "  ".join(passage)), (501, " ".join(passage * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = []
    once = substring_dedup.repeated_windows
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda p, w, lengths, b: cuts.append(lengths[0]) or once(p, w, lengths, b))
    for bucket in (4, 30, 2000):
        got = sorted((tuple(r) for r in substring_dedup.dedup_substrings(df, bucket=bucket, text=False).collect()), key=str)
        assert got == brute_substrings(rows)
    assert cuts[:3] == [8, 26, 35] and cuts[-1] == 8
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(df, keep=["n_words"])


def test_substrings_text_left(odd):
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(odd, keep=["lang"]).collect()}
    assert got[11]["text_left"] == "zz yy" and got[11]["lang"] == "de"
    assert got[6]["text_left"] == ODD[5][1]


def test_token_counts_match_the_library(spark, docs, odd, tmp_path):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    special = spark.createDataFrame([(77, "say <|endoftext|> and <|ENDOFTEXT|> \n\n\t x", None, None, 0, "", "")], SCHEMA)
    marks = [f"{c}{m}" for c in "JHTWYAjhtwya" for m in ("\u030c", "\u0331", "\u0308", "\u030a", "\u0301")]
    composed = spark.createDataFrame([(900 + k, f"{x} and AB{x}c\u00a0D{x} {x}", None, None, 0, "", "") for k, x in enumerate(marks)], SCHEMA)
    special = special.unionByName(composed)
    for df in (docs.select("doc_id", "text"), odd.unionByName(special).select("doc_id", "text")):
        want = sorted(((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or "", add_special_tokens=False).ids)) for r in df.collect()), key=str)
        assert sorted((tuple(r) for r in token_count.count_tokens(df, path).collect()), key=str) == want
    cache = str(tmp_path / "cache")
    first = token_count.count_tokens(odd, path, cache).count()
    rows = spark.read.parquet(cache)
    assert first == len(ODD) and rows.count() == rows.select("content").distinct().count()
    more = odd.select("doc_id", F.concat("text", F.lit("")).alias("text")).unionByName(special.select("doc_id", "text"))
    before = rows.count()
    token_count.count_tokens(more, path, cache).collect()
    assert spark.read.parquet(cache).count() == before + 1 + len(marks)
    piece = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(docs.limit(20), piece).collect()} == {r["doc_id"]: len(sp.encode(r["text"])) for r in docs.limit(20).collect()}


def test_languages(docs, odd, empty):
    got = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert len(held) > 100 and np.mean([got[d]["lang_pred"] == true[d] for d in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    rows = lang_id.identify(odd).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 9)} == {"und"}
    assert lang_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def small_net(rng):
    net = lang_id.ByteNet.fresh(["a", "b", "c"], rng)
    for name in ("embed", "kernel", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    return net


def test_language_forward_pass():
    """Every filter at every place by loops, then the maximum, the output layer and the softmax."""
    rng = np.random.default_rng(3)
    net = small_net(rng)
    x = lang_id.windows_of(rng.integers(1, 250, 300).astype(np.uint8).tobytes())
    assert x.shape == (2, lang_id.WINDOW)
    want = []
    for window in x:
        f = []
        for k, width in enumerate(w for w in lang_id.WIDTHS for _ in range(lang_id.FILTERS)):
            places = [sum(float(net.embed[window[p + j]] @ net.kernel[j * lang_id.EMBED : (j + 1) * lang_id.EMBED, k]) for j in range(width)) for p in range(lang_id.WINDOW - lang_id.WIDE + 1)]
            f.append(max(max(places) + net.bias[k], 0))
        z = np.array(f) @ net.out + net.out_bias
        want.append(z - np.log(np.exp(z).sum()))
    assert np.allclose(net.log_probs(x), want)


def test_language_gradient():
    """The network's gradient against differences of the loss; and training separates two alphabets."""
    rng = np.random.default_rng(8)
    net = small_net(rng)
    x, t, weight = rng.integers(0, 40, (5, lang_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), rng.random(5)
    loss = lambda: float(-(net.log_probs(x)[np.arange(5), t] * weight).sum())
    grads, fixed = net.gradients(x, t, weight), lang_id.mask()
    for name, g in grads.items():
        values = getattr(net, name)
        for at in rng.choice(g.size, min(g.size, 40), replace=False):
            i = np.unravel_index(at, g.shape)
            if name == "kernel" and not fixed[i]:
                continue  # a narrow filter's weights beyond its width stay 0
            old, step = values[i], 1e-6
            values[i] = old + step
            up = loss()
            values[i] = old - step
            down = loss()
            values[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 1e-5, name
    net = lang_id.train([b"abcabc abca bcab"] * 40 + [b"xyzxyz xyzx yzxy"] * 40, ["a"] * 40 + ["b"] * 40)
    said = net.log_probs(np.concatenate([lang_id.windows_of(b"cabcab"), lang_id.windows_of(b"zyxzyx")])).argmax(1)
    assert list(said) == [0, 1]


def test_language_sample(spark, monkeypatch):
    """Of more languages than the sample has rows, those are learned that it holds; else every language is."""
    seen = []
    monkeypatch.setattr(lang_id, "train", lambda windows, langs: seen.append(Counter(langs)))
    df = spark.createDataFrame([(i, f"text {i}", f"l{i % 60}") for i in range(600)], "id long, text string, lang string")
    monkeypatch.setattr(lang_id, "MOST_DOCS", 300)
    lang_id.fit(df)
    assert len(seen[0]) == 60 and max(seen[0].values()) <= 5
    monkeypatch.setattr(lang_id, "MOST_DOCS", 30)
    lang_id.fit(df)
    assert 10 <= sum(seen[1].values()) <= 60


def test_license_places_and_templates(docs, odd, empty, spark):
    for df in (docs, odd):
        for r, t in ((x, x["text"]) for x in license_scan.scan_licenses(df).join(df.select(F.col("doc_id"), "text").distinct(), "doc_id").collect()):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
            places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            assert (r["n_words"], r["n_base"]) == (len(w), len(places))
            assert (r["first_word"], r["last_word"]) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    a = license_scan.compile_template("t", "one <<beginOptional>>or <<var;match=\".{1,2}\">> two<<endOptional>> three")
    run = lambda s: a.spans(s.split(), b" " + s + b" ")
    assert run(b"x one three y one or a b two three") == [(1, 3), (4, 10)]
    assert run(b"one or two three") == [] and run(b"one or a b c two three") == []
    text = "Copyright 2020 Someone. " + re.sub(r'<<var;name="thing".*?>>', 'this software and associated documentation files (the "Software")', re.sub(r"<<(begin|end)Optional>>|<<var;name=\"copyright\".*?>>", "", license_scan.TEMPLATES["mit-text"], flags=re.S), flags=re.S)
    got = license_scan.scan_licenses(spark.createDataFrame([(1, text), (2, text.replace("merge", "merges"))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert "mit-text" in got[0]["labels"] and "mit-text" not in got[1]["labels"]
    assert license_scan.scan_licenses(empty).count() == 0


def template_spans(markup, words):
    """Leftmost longest matches by trying every way to take or leave each region, edges without replaceable words."""

    def read(parts):
        out = [[]]
        while parts:
            part = parts.pop(0)
            if part == "<<endOptional>>":
                break
            if part == "<<beginOptional>>":
                inner = read(parts)
                out = [x + y for x in out for y in [[], *inner]]
            elif part.startswith("<<var"):
                low, high = map(int, re.search(r"\{(\d+),(\d+)\}", part).groups())
                out = [[*x, (low, high)] for x in out]
            else:
                out = [[*x, *license_scan.words_of(part.encode())] for x in out]
        return out

    ways = []
    for way in read(re.split(r"(<<.*?>>)", markup, flags=re.S)):
        while way and isinstance(way[0], tuple):
            way = way[1:]
        while way and isinstance(way[-1], tuple):
            way = way[:-1]
        ways.append(way)

    def ends(way, at):
        if not way:
            return {at}
        if isinstance(way[0], tuple):
            return set().union(*(ends(way[1:], at + k) for k in range(way[0][0], way[0][1] + 1) if at + k <= len(words)))
        return ends(way[1:], at + 1) if at < len(words) and words[at] == way[0] else set()

    out, i = [], 0
    while i < len(words):
        j = max((e for way in ways if way for e in ends(way, i)), default=-1)
        if j > i:
            out.append((i, j))
        i = max(i + 1, j)
    return out


def test_license_templates_match_brute_force():
    rng = np.random.default_rng(6)
    opt, var = lambda x: f"<<beginOptional>>{x}<<endOptional>>", lambda a, b: f'<<var;name="n";match=".{{{a},{b}}}">>'
    markups = [
        f"{opt('a b')}{var(0, 3)} c d", f"{opt('a ' + opt('b'))} {var(1, 2)} c {opt(var(1, 2) + ' d')}", f"{var(1, 2)} a {var(0, 2)} b {var(1, 3)}",
        f"a {opt('b ' + opt('c ' + var(1, 1)) + ' d')} a", f"a {opt('b')}{opt('b')} {var(2, 2)} {opt('c')} d",
    ]
    for markup in markups:
        automaton = license_scan.compile_template("t", markup)
        for _ in range(150):
            words = [bytes([97 + x]) for x in rng.integers(0, 5, rng.integers(0, 16))]
            assert automaton.spans(words, b" " + b" ".join(words) + b" ") == template_spans(markup, words), (markup, words)


def test_license_texts(spark):
    """Every template accepts its own wording, and not with a mandatory word changed; words around a text aren't part of it."""
    whole = {k: re.sub(r"\s+", " ", re.sub(r'<<var;name="[^"]*";original="(.*?)";match=".*?">>', r"\1", re.sub(r"<<(begin|end)Optional>>", "", v), flags=re.S)) for k, v in license_scan.TEMPLATES.items()}
    rows = [(k, t) for k, t in whole.items()] + [(f"{k} changed", t.replace("the", "tho").replace("the", "tho").replace("THE", "THO").replace("License", "Lizense")) for k, t in whole.items()]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for k in whole:
        assert k in got[k]["labels"].split(",") and k not in got[f"{k} changed"]["labels"].split(",")
    grant = whole["mit-text"][whole["mit-text"].index("Permission") :]
    n = len(license_scan.words_of(grant.encode()))
    one = license_scan.scan_licenses(spark.createDataFrame([("x", "word " * 100 + grant + " word" * 50)], "doc_id string, text string")).first()
    assert [(x["label"], x["start"], x["end"]) for x in one["spans"]] == [("mit-text", 100, 100 + n)] and one["score"] == n / (n + 150)


def test_license_time_is_linear():
    """Positions are counted on from the last one."""
    words = b" " + b"mit license " * 60_000
    began = time.perf_counter()
    assert license_scan._places(words, b" mit license ") == list(range(0, 120_000, 2))
    assert time.perf_counter() - began < 5


def test_perspectives(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "ann", "né"), (None, 1, "ann", "x"), (2, 0, "system", "alone"), (3, 70, "ann", "late"), (3, 1, "ann", "early")]
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=64).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (3, "ann", 0), (3, "ann", 1)}
    ann = got[1, "ann", 0]
    assert ann["rendered"] == "<|im_start|>assistant\nné<|im_end|>\n<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    assert [ann["rendered"][s["start"] : s["end"]] for s in ann["spans"]] == ["né<|im_end|>", "hi<|im_end|>"]


def marginals(rows):
    """Expected share of the whole sample's tokens by dimension and value, and all tokens' shares."""
    total = sum(r["n_tokens"] for r in rows)
    have, most = defaultdict(float), defaultdict(float)
    for r in rows:
        for d in ("source", "lang", "topic"):
            have[d, r[d]] += r["p"] * r["n_tokens"] / total
            most[d, r[d]] += r["n_tokens"] / total
    return have, most


def goals_of(most, wanted, budget):
    """Targets times the budget; a value that can't give its part gives all, and the others of its dimension take the rest in proportion."""
    out = {}
    for d in ("source", "lang", "topic"):
        values = [v for (k, v), x in most.items() if k == d and x > 0]
        weight = {v: wanted[d].get(v, 0) if d in wanted else most[d, v] ** mixing.POWERS[d] for v in values}
        full = set()
        while True:
            rest = sum(w for v, w in weight.items() if v not in full)
            left = budget - sum(most[d, v] for v in full)
            goal = {v: most[d, v] if v in full else left * weight[v] / rest for v in values}
            more = {v for v in values if v not in full and goal[v] > most[d, v]}
            if not more:
                break
            full |= more
        out |= {(d, v): g for v, g in goal.items()}
    return out


@pytest.mark.parametrize("driver_cells", [100_000, 1])
def test_mix_meets_its_targets(docs, driver_cells):
    """The expected marginals are the goals, by default and where a cap has to hold."""
    for wanted, budget in (({}, mixing.BUDGET), ({"lang": {"en": 1, "de": 1, "fr": 1, "es": 1}}, mixing.BUDGET), ({}, 0.9))[: 3 if driver_cells > 1 else 1]:
        rows = mixing.mix(docs, targets=wanted, budget=budget, driver_cells=driver_cells).collect()
        have, most = marginals(rows)
        goals = goals_of(most, wanted, budget)
        assert max(abs(have[k] - g) for k, g in goals.items()) < 1e-6
        assert all(0 <= r["p"] <= 1 for r in rows) and abs(sum(r["p"] * r["n_tokens"] for r in rows) / sum(r["n_tokens"] for r in rows) - budget) < 1e-6


def test_mix_meets_targets(docs, odd, empty, spark):
    rows = mixing.mix(docs).collect()
    total = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["p"] * r["n_tokens"] for r in rows) / total - mixing.BUDGET) < 1e-6
    assert abs(sum(r["n_tokens"] for r in rows if r["sampled"]) / total - mixing.BUDGET) < 0.1
    tokens = np.array([0.4, 0.3, 0.2, 0.1])
    codes, goals = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([0.25, 0.25]), np.array([0.2, 0.3])]
    p, off = mixing.rake(tokens, codes, goals, 0.5)
    assert off < mixing.MISSED
    for c, g in zip(codes, goals, strict=True):
        assert np.allclose(np.bincount(c, p * tokens), g, atol=1e-7)
    assert np.allclose(mixing.reachable(np.array([0.2, 0.2, 0.1]), np.array([0.05, 0.9, 0.1])), [0.05, 0.35, 0.1])
    far, near = (sorted((r["doc_id"], r["p"]) for r in mixing.mix(docs, driver_cells=k).collect()) for k in (1, 100_000))
    assert np.allclose([p for _, p in far], [p for _, p in near], rtol=0, atol=1e-6)
    assert len(mixing.mix(odd).collect()) == len(ODD) and mixing.mix(empty).count() == 0
    p = {r["doc_id"]: r for r in mixing.mix(odd).collect()}
    assert p[1]["p"] == 0 and not p[1]["sampled"]
    kept = mixing.mix(odd, keep=["text", "n_chars"]).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted((str(r[0]), str(r[1])) for r in ODD)
    with pytest.raises(ValueError):
        mixing.mix(odd, keep=["lang"])


def test_mix_tells_contradicting_targets(spark):
    """All of source a is in English, so a can't give half of a sample that is to be French for the most part."""
    df = spark.createDataFrame([(1, "w " * 100, "en", "a"), (2, "w " * 50, "en", "b"), (3, "w " * 50, "fr", "b")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="contradict"):
        mixing.mix(df, targets={"source": {"a": 0.8, "b": 0.2}, "lang": {"en": 0.5, "fr": 0.5}}, topic=F.lit("x")).collect()


def test_mix_far_fit_goes_the_same_rounds(spark, monkeypatch):
    """Many mostly one-language sources, whose targets contradict each other: after any round both paths are alike, and the fit ends."""
    cells = [(i, i % 4, 40 + i * i * 7 % 160 + 400 * (i % 4 == 0)) for i in range(24)] + [(i, (i + 1) % 4, 20 + i % 5) for i in range(0, 24, 2)]
    df = spark.createDataFrame([(n, "w " * c, f"l{b}", f"s{a}") for n, (a, b, c) in enumerate(cells)], "doc_id long, text string, lang string, source string")
    for rounds in (1, 4):
        monkeypatch.setattr(mixing, "ROUNDS", rounds)
        with pytest.warns(UserWarning, match="contradict"):
            near, far = (np.array([r["p"] for r in mixing.mix(df, topic=F.lit("x"), driver_cells=k).orderBy("doc_id").collect()]) for k in (100, 1))
        assert np.allclose(far, near, rtol=0, atol=1e-9)
    monkeypatch.setattr(mixing, "ROUNDS", 10_000)
    tokens, codes = np.array([float(c[2]) for c in cells]) / sum(c[2] for c in cells), [np.array([c[k] for c in cells]) for k in (0, 1)]
    goals = [0.5 * mixing.targets_of(np.bincount(c, tokens), mixing.POWERS[d]) for c, d in zip(codes, ("source", "lang"), strict=True)]
    began = time.perf_counter()
    p, off = mixing.rake(tokens, codes, goals, 0.5)
    assert mixing.MISSED < off < 0.05 and time.perf_counter() - began < 1


def plain(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute_leaks(rows, items):
    out = set()
    for d, t in rows:
        w = plain(t)
        for item, bt in items:
            b = plain(bt)
            k, n = min(5, len(b)), len(b)
            if not b:
                continue
            gram = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
            gb = gram(b)
            if not gram(w).keys() & gb.keys():
                continue
            for s in range(max(1, len(w) - n + 1)):
                g = gram(w[s : s + n])
                if sum((g & gb).values()) >= 0.8 * sum((g | gb).values()):
                    out.add((d, item))
                    break
    return out


def test_leaks_match_brute_force(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, items = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(rows, items)
    assert len(got) >= 26
    words = [f"v{i}" for i in range(60)]
    edited = [*words[:20], "odd", *words[21:]]
    small = spark.createDataFrame([(1, "Lead in. " + " ".join(words).upper() + "! Tail"), (2, " ".join(edited)), (3, " ".join(words[:30])), (4, None), (5, "two words")], "doc_id long, text string")
    own = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "Two, words")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(small, own).collect()} == {(1, 1), (2, 1), (5, 4)}
    assert decontaminate.contaminated(odd, own).count() == 0
    assert decontaminate.contaminated(empty, own).count() == 0 and decontaminate.contaminated(small, own.where("false")).count() == 0


@pytest.mark.parametrize("broadcast", [0, decontaminate.BROADCAST_SHINGLES])
def test_leaks_with_moved_parts(spark, monkeypatch, broadcast):
    """Shared shingles at other places than the item's: swapped parts, and cut ends with an insertion."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", broadcast)
    rng = np.random.default_rng(3)
    a, b = [f"v{i}" for i in range(60)], [f"u{i}" for i in range(200)]
    pad = [f"p{i}" for i in range(90)]
    turned = [*a[50:], *a[:50]]
    cut = [*b[8:100], "in", "between", *b[100:192]]
    some = [[*pad[:40], *turned, *pad[40:]], turned, [*pad, *cut, *pad], [*cut, *pad], [*a[20:], *a[:20]], [*pad, *a[:30], *a[:30]], [*turned[:57]], a * 3]
    for _ in range(40):
        w, i, j = list(a), *sorted(rng.integers(0, 60, 2).tolist())
        w = [*w[j:], *w[i:j], *w[:i]] if rng.random() < 0.5 else [*w[:i], *[f"x{k}" for k in range(j % 4)], *w[i + j % 3 :]]
        some.append([*pad[:i], *w, *pad[:j]])
    rows, items = [(i, " ".join(w)) for i, w in enumerate(some)], [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(reversed(a)))]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(rows, items)
    assert {(0, 1), (1, 1), (2, 2), (3, 2)} <= {(r["doc_id"], r["item_id"]) for r in got}


def test_leaks_of_a_repeated_passage(spark):
    """Every place of the passage has its windows, with their similarities."""
    words = [f"w{i * 7919 % 1003}" for i in range(2500)]
    item = words[1994:2054]
    texts = spark.createDataFrame([(b"t", " ".join(words))], "td binary, text string")
    got = {r["start"]: r["similarity"] for r in decontaminate.leaks(texts, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    want = {at + k: (56 - abs(k)) / (56 + abs(k)) for at in (991, 1994) for k in range(-6, 7)}
    assert got == want


def test_leaks_among_many_items_of_one_length(spark):
    """The blocks meet a small part of all items, and no window of a planted passage, edited or not, is missed."""
    rng = np.random.default_rng(11)
    items = [[f"t{x}" for x in rng.integers(0, 30, 25)] for _ in range(3000)]
    rows = []
    for d in range(120):
        w = list(items[d])
        if d % 3 == 1:
            w[0], w[24] = "edited", "too"
        if d % 3 == 2:
            w = [*w[:24], "cut"]
        rows.append((d, " ".join(["some", "lead", *w, "and", "more"])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(d, d) for d in range(120) if d % 3 != 1}
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    theirs = spark.range(300).select(F.xxhash64("id", F.lit(1)).alias("item_fp"))
    met = decontaminate._blocks(fps, "fp", decontaminate.WINDOW_FLIPS).join(decontaminate._blocks(theirs, "item_fp", decontaminate.ITEM_FLIPS), ["block", "value"]).select("fp", "item_fp").distinct()
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    assert 0.1 < met.count() / 600_000 < 0.2
    assert met.where(distance <= decontaminate.RADIUS).count() == fps.crossJoin(theirs).where(distance <= decontaminate.RADIUS).count() > 0


def test_urls(spark):
    rows = [
        (1, "https://Shop.NET/x?y#z", None),
        (2, "http://a.example.net/en/1", ""),
        (3, "http://alias.org/p", '<link rel="canonical" href="http://www.shop.net/x?y">'),
        (4, "http://other.org/q/", '<meta http-equiv="refresh" content="0; url=http://alias.org/p">'),
        (5, "http://other.org/fr/1", '<link href="http://alias.org/p" rel=canonical>'),
        (6, None, None),
        (7, "no url", "<p>"),
        (8, "http://net/", ""),
        (9, "http://net", ""),
        (10, "http://a.b.example.com/de/x?://c.net/", ""),
        (11, "http://lone.org/1", '<link rel="canonical" href="/2">'),
        (11, "http://lone.org/1", '<link rel="canonical" href="/2">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for rules in (queries.URL_RULES, queries.URL_RULES + [("block", f"none{i}.test", "/") for i in range(80)]):
        got = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules).collect()}
        assert [(got[k]["host"], got[k]["path"]) for k in (1, 6, 7, 9, 10)] == [("shop.net", "/x"), ("", ""), ("", ""), ("net", ""), ("a.b.example.com", "/de/x")]
        assert {k: (r["rule"], r["verdict"]) for k, r in got.items()} == {
            1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("org/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"),
            8: ("net/", "block"), 9: (None, "block"), 10: ("example.com/de/", "block"), 11: (None, "allow"),
        }
        no5 = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages.where("page_id <> 5"), rules).collect()}
        assert no5[3] == no5[4] == "block" and no5[11] == "allow"
    assert url_filter.judge_urls(pages.where("false"), queries.URL_RULES).count() == 0


def test_urls_by_relative_links(spark):
    """Targets of each form against the standard library, and pages that inherit a block through them."""
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b/c.html?q=1", "http://h.org", "http://h.org/", "http://h.org/a/b/", "http://h.org?q=2"]
    targets = ["page.html", "./x", "../x", "../../../x", "?id=1", "/y/../z", "//o.org/p", "https://o.org/q", "d/e/./f?x=/../y", "..", ".", "#top", "/", "x/..", "?u=http://o.org/"]
    rows = [(b, x) for b in bases for x in targets]
    got = spark.createDataFrame(rows, "url string, x string").select("url", "x", url_filter.node_of(url_filter.resolved(F.col("x"), F.col("url"))).alias("got")).collect()
    want = spark.createDataFrame([(b, x, urljoin(b, x)) for b, x in rows], "url string, x string, w string").select("url", "x", url_filter.node_of(F.col("w")).alias("want")).collect()
    assert {(r["url"], r["x"]): r["got"] for r in got} == {(r["url"], r["x"]): r["want"] for r in want}

    link = lambda x: f'<link rel="canonical" href="{x}">'
    forms = ["blocked.html", "./blocked.html", "../d/blocked.html", "/d/blocked.html", "blocked.html?a=1&amp;b=2", "blocked.html?a=1&#38;b=2", "mailto:x@h.org"]
    pages = [(0, "http://h.org/d/blocked.html", ""), (1, "http://h.org/d/blocked.html?a=1&b=2", "")] + [(k, f"http://h.org/d/p{k}", link(x)) for k, x in enumerate(forms, 2)]
    pages.append((20, "http://h.org/d/blocked.html?v=1", '<meta http-equiv="refresh" content="0; url=?v=2">'))
    pages.append((21, "http://h.org/d/blocked.html?v=2", ""))
    pages.append((30, "http://h.org/e/1", '<base href="/d/">' + link("blocked.html")))
    no_links = ["<!-- " + link("blocked.html") + " -->", "<script>var x = '" + link("blocked.html") + "'</script>", "<STYLE>" + link("blocked.html") + "</style >", "<!-- open " + link("blocked.html"), "canonical " + link("../e/free.html")]
    pages += [(40 + k, f"http://h.org/d/n{k}", x) for k, x in enumerate(no_links)]
    rules = [("block", "h.org", "/d/blocked.html")]
    verdict = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert {k: v[1] for k, v in verdict.items()} == {k: "allow" if k == 8 or k >= 40 else "block" for k in verdict}
    assert all(verdict[k][0] is None for k in range(2, 9))


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(common, "SEGMENT", 7)
    texts = [b"", b" a  bb\tccc\x0b", "ünï a".encode(), b"x" * 40, b"\n", b"bb a"]
    words = common.Words(texts)
    split = [t.split() for t in texts]
    assert np.diff(words.offsets).tolist() == [len(w) for w in split]
    flat = [w for ws in split for w in ws]
    assert [words.text(i, i + 1) for i in range(len(flat))] == flat and words.text(0, 3) == b"a bb ccc"
    by_word = {w: int(h) for w, h in zip(flat, words.hashes, strict=True)}
    assert all(by_word[w] == int(h) for w, h in zip(flat, words.hashes, strict=True)) and len(set(by_word.values())) == len(by_word)
    assert len(common.Words([]).hashes) == 0


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, None)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent}


def test_a_hub_is_split(spark):
    """The join with a written minimum splits a node that half of all edges end at."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    had = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        edges = common.materialize(spark.range(200_000).select((F.col("id") + 1_000_000).alias("u"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("v")), "edges")
        both = edges.select(graph._pairs(("u", "v"), ("v", "u")))
        least = common.materialize(both.groupBy("u").agg(F.min("v").alias("m")), "edges")
        found = graph._with_least(both, least).agg(F.count("*"))
        assert found.collect()[0][0] == 400_000 and "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def test_quality_rules(odd, empty):
    good = [f"Sentence {i} has x{i} words{i} of y{i} number{i}, z{i} own{i}." for i in range(9)]
    text = "\n".join([*good, "Home | About | Contact.", "no sentence end", "All rights reserved.", good[1]])
    n, chars, symbols, dup, repeats, failed, kept, left, rest = quality.judge_text(text.encode())
    lost = sum(len(x.split()) for x in ("Home | About | Contact.", "no sentence end", "All rights reserved."))
    assert (n, dup, failed, kept, symbols) == (len(text.split()), 1, False, True, 2) and chars == len("".join(text.split()))
    assert left == n - lost and b"rights" not in rest and b"Home" not in rest and b"no sentence" not in rest
    assert repeats == 2 * len(good[1].split()) and quality.judge_text(b"x y z " * 40)[4] == 120
    assert not quality.judge_text("\n".join([*good, *["no end here at all"] * 40]).encode())[6]
    rows = quality.judge_documents(odd, ["doc_id"]).collect()
    assert len(rows) == len(ODD) and quality.judge_documents(empty, ["doc_id"]).count() == 0
