"""Convergent values as aggregates over stamped rows.

Stamps are hlc structs; rows may come in any order and more than once. Where two rows carry the
same stamp, the larger value counts, so that results don't depend on the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hlc import later


def lww(rows: DataFrame, key: list[str], values: dict[str, str], stamp: str = "hlc") -> DataFrame:
    """Last-writer-wins registers: {output: value column}, all by one stamp."""
    last = F.max(F.struct(F.col(stamp).alias("s"), F.struct(*[F.col(v).alias(n) for n, v in values.items()]).alias("v")))
    return rows.groupBy(*key).agg(last.alias("m")).select(*key, *[F.col(f"m.v.`{n}`").alias(n) for n in values], F.col("m.s").alias(stamp))


def lww_fields(rows: DataFrame, key: list[str], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Registers with a stamp each: {output: (value column, stamp column)}; one aggregate for all."""
    last = lambda v, s: F.max(F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("s"), F.col(v).alias("v"))))["v"]
    return rows.groupBy(*key).agg(*[last(v, s).alias(n) for n, (v, s) in fields.items()])


def lww_map(rows: DataFrame, key: list[str], entry: str, value: str, deleted: str, stamp: str = "hlc") -> DataFrame:
    """Every entry's last write or delete: key, entry, value (null if deleted), deleted, stamp."""
    last = F.max(F.struct(F.col(stamp).alias("s"), F.col(deleted).alias("d"), F.col(value).alias("v")))
    return rows.groupBy(*key, entry).agg(last.alias("m")).select(*key, entry, F.when(~F.col("m.d"), F.col("m.v")).alias(value), F.col("m.d").alias(deleted), F.col("m.s").alias(stamp))


def live(entries: DataFrame, deleted: str = "deleted") -> DataFrame:
    return entries.where(~F.col(deleted)).drop(deleted)


def counter(rows: DataFrame, key: list[str], node: str, delta: str) -> DataFrame:
    """PN-counter state from increments: key, node, inc, dec (both totals of positive amounts)."""
    d = F.col(delta)
    return rows.groupBy(*key, node).agg(F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0)).alias("inc"), F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0)).alias("dec"))


def merge_counters(states: DataFrame, key: list[str], node: str) -> DataFrame:
    """Replicas' states joined: totals only grow, so the largest is the newest."""
    return states.groupBy(*key, node).agg(F.max("inc").alias("inc"), F.max("dec").alias("dec"))


def counter_value(states: DataFrame, key: list[str]) -> DataFrame:
    return states.groupBy(*key).agg((F.sum("inc") - F.sum("dec")).alias("value"))


def or_set_tags(adds: DataFrame, removes: DataFrame, key: list[str], element: str, tag: str, seen: Column) -> DataFrame:
    """Add-wins set, from add rows (key, element, tag) and remove rows: a remove deletes the tags for which seen
    (a condition on columns of adds aliased a and removes aliased r) is true, and no others."""
    match = seen
    for k in key:
        match = match & (F.col(f"a.{k}") == F.col(f"r.{k}"))
    dead = adds.alias("a").join(removes.alias("r"), match, "left_semi").select(*key, element, tag).withColumn("deleted", F.lit(True))
    return adds.select(*key, element, tag).withColumn("deleted", F.lit(False)).unionByName(dead).groupBy(*key, element, tag).agg(F.bool_or("deleted").alias("deleted"))


def or_set_items(tags: DataFrame, key: list[str], element: str) -> DataFrame:
    """Elements with a live tag."""
    return tags.groupBy(*key, element).agg(F.bool_or(~F.col("deleted")).alias("live")).where("live").drop("live")


def newest(*stamps: Column) -> Column:
    return later(*stamps)


def stamped_metadata(ops: DataFrame, key: list[str], stamp: str = "hlc") -> DataFrame:
    """The clocks that ops leave behind: key, path, write_hlc, tomb_hlc."""
    gone = F.col("kind") == "remove"
    return ops.groupBy(*key, "path").agg(F.max(F.when(~gone, F.col(stamp))).alias("write_hlc"), F.max(F.when(gone, F.col(stamp))).alias("tomb_hlc"))


def accepted(ops: DataFrame, state: DataFrame, key: list[str], stamp: str = "hlc") -> DataFrame:
    """The ops that are strictly newer than what the replica knows of their exact path (path "/a" and "/a/b" never meet)."""
    known = state.select(*key, "path", newest(F.col("write_hlc"), F.col("tomb_hlc")).alias("_known"))
    return ops.join(known, [*key, "path"], "left").where(F.col("_known").isNull() | (F.col(stamp) > F.col("_known"))).drop("_known")


def apply_deltas(state: DataFrame, ops: DataFrame, key: list[str], stamp: str = "hlc") -> DataFrame:
    """Replica state (key, path, value, write_hlc, tomb_hlc) after any number of deltas: of each path's ops the newest
    counts, if it is strictly newer than the state. One aggregate and one join."""
    gone = F.col("kind") == "remove"
    last = F.max(F.struct(F.col(stamp).alias("s"), gone.alias("gone"), F.col("new").alias("new")))
    per = ops.groupBy(*key, "path").agg(last.alias("m"), F.max(F.when(~gone, F.col(stamp))).alias("w"), F.max(F.when(gone, F.col(stamp))).alias("t"))
    both = state.join(per, [*key, "path"], "full_outer")
    known = newest(F.col("write_hlc"), F.col("tomb_hlc"))
    newer = F.col("m").isNotNull() & (known.isNull() | (F.col("m.s") > known))
    value = F.when(newer, F.when(~F.col("m.gone"), F.col("m.new"))).otherwise(F.col("value"))
    return both.select(*key, "path", value.alias("value"), newest(F.col("write_hlc"), F.col("w")).alias("write_hlc"), newest(F.col("tomb_hlc"), F.col("t")).alias("tomb_hlc"))


def merge_replicas(local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """Two replicas' full states joined on the path: the strictly newer value wins, a remote one without a stamp never does; clocks by their maximum."""
    a, b = (df.select(*key, "path", F.struct("value", "write_hlc", "tomb_hlc").alias(n)) for df, n in ((local, "a"), (remote, "b")))
    both = a.join(b, [*key, "path"], "full_outer")
    mine, theirs = (newest(F.col(f"{n}.write_hlc"), F.col(f"{n}.tomb_hlc")) for n in "ab")
    wins = theirs.isNotNull() & (mine.isNull() | (theirs > mine))
    return both.select(*key, "path", F.when(wins, F.col("b.value")).otherwise(F.col("a.value")).alias("value"), newest(F.col("a.write_hlc"), F.col("b.write_hlc")).alias("write_hlc"), newest(F.col("a.tomb_hlc"), F.col("b.tomb_hlc")).alias("tomb_hlc"))


def view(state: DataFrame, key: list[str], paths: list[str]) -> DataFrame:
    """A column for each path, named without its slash; absent and deleted values are null."""
    return state.groupBy(*key).agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(p.removeprefix("/")) for p in paths])
