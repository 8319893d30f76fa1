"""Moves and copies found by value."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import canonical
from ..functions.schema import leaves


def values_of(df: DataFrame, key: list[str], ignore: Iterable[str] = (), schema=None) -> DataFrame:
    """key, path, value: every non-null leaf that can be indexed by value (lists and maps can't), as canonical JSON text."""
    found = [x for x in leaves(schema or df.schema, key, ignore) if x.dtype.typeName() not in ("array", "map")]
    pairs = F.array(*[F.struct(F.lit(x.path).alias("path"), canonical(F.col(".".join(f"`{n}`" for n in x.names)), x.dtype).alias("value")) for x in found])
    return df.select(*key, F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def detect_moves(a: DataFrame, b: DataFrame, key: list[str], scope: list[str] | None = None, ignore: Iterable[str] = (), schema=None) -> DataFrame:
    """key, kind (move or copy), from_path, path, value: values of b that a has elsewhere.

    A value new at a path and gone from another is a move, removals and additions of one value paired in
    order of their paths; beyond those, a value that stays where it was is copied, from its smallest
    path. scope: columns within which values are matched, the entity key by default.
    """
    scope = key if scope is None else scope
    old, new = values_of(a, key, ignore, schema), values_of(b, key, ignore, schema)
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), [*key, "path"], "full_outer")
    changed = both.where(~F.col("old").eqNullSafe(F.col("new")))
    line = lambda v: Window.partitionBy(*scope, v).orderBy("path", *[k for k in key if k not in scope])
    gone = changed.where("old is not null").withColumn("n", F.row_number().over(line("old"))).select(*scope, F.col("old").alias("value"), "n", F.col("path").alias("from_path"), F.lit(True).alias("left_"))
    come = changed.where("new is not null").withColumn("n", F.row_number().over(line("new"))).select(*key, F.col("new").alias("value"), "n", "path")
    stay = both.where("old <=> new").groupBy(*scope, F.col("old").alias("value")).agg(F.min("path").alias("stay_path"))
    # A value that stays is copied; only values that are nowhere else are moved.
    out = come.join(stay, [*scope, "value"], "left").join(gone, [*scope, "value", "n"], "left")
    out = out.where("left_ or stay_path is not null")
    moved = F.col("left_").isNotNull()
    return out.select(*key, F.when(moved, "move").otherwise("copy").alias("kind"), F.when(moved, F.col("from_path")).otherwise(F.col("stay_path")).alias("from_path"), "path", "value")


def fold_moves(ops: DataFrame, moves: DataFrame, key: list[str]) -> DataFrame:
    """Op rows with each found move or copy in place of its addition; a moved value's removal goes."""
    m = moves.select(*key, "path", F.col("kind").alias("_kind"), F.col("from_path").alias("_from"))
    gone = moves.where("kind = 'move'").select(*key, F.col("from_path").alias("path"), F.lit(True).alias("_gone"))
    out = ops.join(m, [*key, "path"], "left").join(gone, [*key, "path"], "left").where("not (kind = 'remove' and coalesce(_gone, false))")
    found = F.col("_kind").isNotNull()
    return out.select(*key, "seq", F.coalesce("_kind", "kind").alias("kind"), "path", F.when(found, F.col("_from")).otherwise(F.col("from_path")).alias("from_path"), F.when(~found, F.col("old")).alias("old"), F.when(~found, F.col("new")).alias("new"))
