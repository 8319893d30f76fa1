"""The pipeline's stages against brute force, on the small tables and on odd rows."""

import pytest
from pyspark.sql import functions as F
from test_operators import ODD, SCHEMA, brute_classes, brute_leaks, brute_substrings

import corpus_pipeline as P
from changeset.llm import mixing, quality
from changeset.llm.common import materialize

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_stages_match_brute_force(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if which == "odd":
        docs = spark.createDataFrame(ODD, SCHEMA).withColumn("td", F.lit("clash"))
    first = materialize(P.quality_rules(spark, docs, SF), "t")
    judged = [(d, quality.judge_text((t or "").encode())) for d, t in rows(docs)]
    assert sorted(rows(first), key=str) == sorted(((d, j[8].decode()) for d, j in judged if j[6]), key=str)

    second = materialize(P.near_duplicates(spark, first, SF), "t")
    kept = [d for d, _, _, k in brute_classes(rows(first), 5) if k]  # the operator's own five words; four are op3_near_dedup's
    assert sorted(d for d, _ in rows(second) if d is not None) == sorted(set(kept))

    third = materialize(P.repeated_passages(spark, second, SF), "t")
    cut = {(d, n, gone) for d, n, gone, _ in brute_substrings(rows(second))}
    assert {d for d, _ in rows(third)} == {d for d, n, gone in cut if not gone or gone < n}
    assert {d: len(t.split()) for d, t in rows(third)} == {d: n - gone for d, n, gone in cut if not gone or gone < n}

    fourth = materialize(P.benchmark_leaks(spark, third, SF), "t")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_leaks(rows(third), items)}
    assert {d for d, _ in rows(fourth)} == {d for d, _ in rows(third)} - bad

    fifth = P.source_mix(spark, fourth, SF).collect()
    assert {r["doc_id"] for r in fifth} == {r["doc_id"] for r in mixing.mix(fourth).collect() if r["sampled"]}
    for step in (first, second, third, fourth):
        assert step.columns == P.COLUMNS
        assert all(r["n_chars"] == len(r["text"]) for r in step.collect())


def test_near_duplicates_with_repeated_ids(spark):
    """One row of each group of texts stays, also where an id stands for texts of several groups."""
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    named = [(5, text("a")), (5, text("b")), (3, text("b")), (7, text("c")), (7, text("d")), (7, text("d")), (7, text("d") + " end"), (8, ""), (8, " ")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in named], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((d, t.split(" ")[0]) for d, t in rows(P.near_duplicates(spark, docs, SF)))
    assert left == [(3, "b0"), (5, "a0"), (7, "c0"), (7, "d0"), (8, ""), (8, "")]


def test_run(spark):
    got = P.run(spark, SF)
    assert got.count() > 20 and {"doc_id", "p"} <= set(got.columns)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
    assert docs.count() == 0
