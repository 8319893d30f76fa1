"""Merging patch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .apply import apply_table
from .diff import diff
from .ops import op_table

#: (path, local new value, remote new value) -> merged value, all as JSON text; null values are removals.
Resolver = Callable[[Column, Column, Column], Column]


def remote_wins(path: Column, local: Column, remote: Column) -> Column:
    return remote


def local_wins(path: Column, local: Column, remote: Column) -> Column:
    return local


def _greater(x: Column, y: Column) -> Column:
    """Whether the JSON value x is greater than y: numbers by their amount, strings by their characters, else by their text."""
    number = lambda v: F.when(~v.startswith('"'), v.try_cast("decimal(38,10)"))
    inexact = lambda v: F.when(~v.startswith('"'), v.try_cast("double"))
    string = lambda v: F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"))
    return F.coalesce(number(x) > number(y), inexact(x) > inexact(y), string(x) > string(y), x > y)


def largest(path: Column, local: Column, remote: Column) -> Column:
    return F.when(local.isNull(), remote).when(remote.isNull(), local).otherwise(F.when(_greater(local, remote), local).otherwise(remote))


def smallest(path: Column, local: Column, remote: Column) -> Column:
    return F.when(local.isNull(), remote).when(remote.isNull(), local).otherwise(F.when(_greater(local, remote), remote).otherwise(local))


def either(path: Column, local: Column, remote: Column) -> Column:
    return F.coalesce(remote, local)


def merge_tables(base: DataFrame, other: DataFrame, key: list[str], resolver: Resolver | None = None) -> DataFrame:
    """One op for each entity and path of either patch, in order of path.

    Of a path within base the first op counts, within other the last. A path in both takes other's op, or,
    with a resolver, a replace (remove for null) to what it makes of the two. Guards are not carried over.
    One aggregate on (entity, path), partially aggregated before the shuffle.
    """
    b = op_table(base, key).withColumn("_s", F.lit(0)).withColumn("_o", -F.col("seq"))
    o = op_table(other, key).withColumn("_s", F.lit(1)).withColumn("_o", F.col("seq"))
    fields = ["kind", "from_path", "old", "new", "if_cond", "unless_cond", "strict"]
    both = b.unionByName(o).groupBy(*key, "path")
    picked = both.agg(*[F.max_by(F.struct(*fields), F.when(F.col("_s") == s, F.col("_o"))).alias(n) for s, n in ((0, "mine"), (1, "theirs"))])
    one = F.coalesce("theirs", "mine")
    if resolver:
        new = resolver(F.col("path"), F.col("mine.new"), F.col("theirs.new"))
        settled = F.struct(
            F.when(new.isNull(), "remove").otherwise("replace").alias("kind"), F.lit(None).cast("string").alias("from_path"), F.coalesce("mine.old", "theirs.old").alias("old"), new.alias("new"),
            F.lit(None).cast("string").alias("if_cond"), F.lit(None).cast("string").alias("unless_cond"), F.col("theirs.strict").alias("strict"),
        )
        one = F.when(F.col("mine").isNotNull() & F.col("theirs").isNotNull(), settled).otherwise(one)
    out = picked.select(*key, "path", one.alias("op"))
    seq = F.row_number().over(Window.partitionBy(*key).orderBy("path")) - 1
    return out.select(*key, seq.alias("seq"), "op.kind", "path", "op.from_path", "op.old", "op.new", "op.if_cond", "op.unless_cond", "op.strict")


def three_way(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: list[str], resolver: Resolver | None = None) -> DataFrame:
    """base with both sides' changes; paths that both change take theirs or the resolver's value.

    Rows that a side adds come, with theirs (or the resolver's text) where both add one; rows that a side removes
    go, whatever the other side changed in them.
    """
    fields = [f for f in base.schema if f.name not in key]
    if resolver is None and not any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) for f in fields):
        return _three_way_fields(base, mine, theirs, key, [f.name for f in fields])
    merged = merge_tables(diff(base, mine, key), diff(base, theirs, key), key, resolver)
    return apply_table(base, merged, key)


def _three_way_fields(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The same where fields are single values: each table is read once, and an entity's three rows meet in one aggregate."""
    side = lambda df, n: df.select(*key, F.lit(n).alias("_side"), F.struct(*[F.col(f"`{f}`").alias(f) for f in fields]).alias("_row"))
    rows = side(base, 0).unionByName(side(mine, 1)).unionByName(side(theirs, 2))
    met = rows.groupBy(*key).agg(*[F.max(F.when(F.col("_side") == n, F.col("_row"))).alias(c) for n, c in enumerate(("_a", "_b", "_c"))])
    a, b, c = (F.col(x) for x in ("_a", "_b", "_c"))
    left = met.where(F.when(a.isNull(), F.lit(True)).otherwise(b.isNotNull() & c.isNotNull()))
    theirs_new = lambda f: F.when(a.isNull(), c.isNotNull()).otherwise(~c[f].eqNullSafe(a[f]))
    none = F.array().cast("array<string>")
    return left.select(*key, *[F.when(theirs_new(f), c[f]).otherwise(b[f]).alias(f) for f in fields], F.lit("ok").alias("status"), none.alias("errors"))


def undo(state: DataFrame, history: DataFrame, key: list[str], version: str) -> DataFrame:
    """The state before the patches in history (op rows with a version), the latest undone first."""
    from .ops import reverse_table

    back = reverse_table(history.withColumn("seq", F.row_number().over(Window.partitionBy(*key).orderBy(version, "seq")) - 1), key)
    return apply_table(state, back, key)
