"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, source mix.

Part of the llm subpackage. Each stage takes (spark, docs, sf_dir) and returns what it keeps; run()
writes every stage's result to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeset.llm import decontaminate, mixing, near_dedup, quality, substring_dedup
from changeset.llm.common import digest, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines; n_chars follows the text. Null, empty and short texts fail;
    a null id is handed on, repeated rows are judged alike, other columns are left out, an empty table gives no rows."""
    judged = quality.judge_documents(docs, ["doc_id", "lang", "source"]).where("kept")
    return judged.select("doc_id", F.col("text_left").alias("text"), "lang", "source", F.length("text_left").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8. Documents without words are each their own group;
    of its rows with the kept id one stays, and rows without an id stay, as no group can name them.
    Rows are told apart by id and text, so each group keeps one where an id is repeated with other texts."""
    kept = near_dedup.classes(docs, texts=True).where("kept").groupBy("doc_id", "root").agg(F.min("td").alias("td")).select("doc_id", "td")
    named = docs.where("doc_id is not null").withColumn("td", digest(F.col("text"))).join(kept, ["doc_id", "td"]).dropDuplicates(["doc_id", "td"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur anywhere else; those of which nothing is left go. Texts without words have no
    passage and stay, as do null ids; of repeated rows each loses what the other has."""
    cut = substring_dedup.dedup_substrings(docs, keep=["lang", "source"])
    left = cut.where("n_removed = 0 or n_removed < n_words")
    return left.select("doc_id", F.col("text_left").alias("text"), "lang", "source", F.length("text_left").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none. Repeated rows stay or go together."""
    texts = docs.select(digest(F.col("text")).alias("td"), "text")
    found = decontaminate.leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("td").distinct()
    return docs.withColumn("td", digest(F.col("text"))).join(found, "td", "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn, with topic, number of words and the probability of being drawn. Texts without words are not drawn."""
    return mixing.mix(docs, keep=["text", "n_chars"]).where("sampled").drop("sampled")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("benchmark leaks", benchmark_leaks), ("source mix", source_mix)]

#: SQL can't express sketches, fingerprints and the iterated fit; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
