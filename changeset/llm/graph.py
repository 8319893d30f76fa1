"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Edge tables of at most so many rows stay in one partition, so that their rounds need no shuffle; larger ones are dealt out.
ONE_TASK = 100_000


def _pairs(*columns: tuple[str, str]) -> Column:
    """A row (u, v) for each pair of columns."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in columns]))


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """The rows (u, v) beside their node's minimum (u, m). With a written minimum, a node's rows may be split over tasks."""
    return rows.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root) for every node with an edge to another; root is the smallest node reached.

    Alternates large-star and small-star steps until the edges stop changing; each
    round ends in a written table, so lineage stays short. Neighbourhoods are never
    gathered: a step takes a partially aggregated minimum, writes it and joins it back. Both sides
    of the join then come from plain exchanges, so the rows of a node with very many neighbours are split at run time.
    The steps are the same at every size; a table that is small by its count just isn't dealt out, nor its minimum written.
    Edges with a null end and loops are dropped. No edges: no rows.
    """
    pair = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialize(pair.where("u <> v").distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == before or not seen[0]:
            break
        before, done = seen, [now]
        small = seen[0] <= ONE_TASK

        def written(df: DataFrame, keep: list[DataFrame] = done, small: bool = small) -> DataFrame:
            if small:
                return df
            keep.append(materialize(df, "edges"))
            return keep[-1]

        both = (now.coalesce(1) if small else now).select(_pairs(("u", "v"), ("v", "u")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(_with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        now = materialize(_with_least(large, low).select(_pairs(("v", "m"), ("u", "m"))).where("u <> v").distinct(), "edges")
        release(*done)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
