"""Hybrid logical clocks: struct<w: wall, l: logical, n: node>, ordered by its fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HLC = "struct<w:bigint,l:int,n:string>"


def hlc(wall, logical, node) -> Column:
    return F.struct(wall.cast("bigint").alias("w"), logical.cast("int").alias("l"), node.cast("string").alias("n"))


def text(stamp: Column) -> Column:
    return F.concat_ws(":", stamp["w"].cast("string"), stamp["l"].cast("string"), stamp["n"])


def zero(node: str = "") -> Column:
    return hlc(F.lit(0), F.lit(0), F.lit(node))


def later(*stamps: Column) -> Column:
    """The largest; null stamps don't count."""
    return F.greatest(*stamps)


def reserve(calls: DataFrame, node: str, order: list[str], phys: str, n: str, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """Adds w and l: what each node's clock returns for its calls in order, each reserving n logical ticks.

    The wall is the running maximum of physical time. Within one wall value the logical part is the
    sum of earlier reservations; it starts from 0, or from the clock's own for its initial wall.
    """
    line = Window.partitionBy(node).orderBy(*order)
    walled = calls.withColumn("w", F.greatest(F.max(phys).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(start[0])).cast("bigint"))
    run = Window.partitionBy(node, "w").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.when(F.col("w") == start[0], start[1]).otherwise(0)
    return walled.withColumn("l", (F.coalesce(F.sum(n).over(run), F.lit(0)) + base).cast("int"))


def receive(events: Column, node: str) -> Column:
    """A clock's state after a sorted array of struct<phys, remote: hlc or null>: null remotes are local ticks. A fold, as receiving isn't associative."""
    start = hlc(F.lit(0), F.lit(0), F.lit(node))

    def step(c: Column, e: Column) -> Column:
        r = e["remote"]
        wall = F.greatest(c["w"], e["phys"], F.coalesce(r["w"], F.lit(0).cast("bigint")))
        both = F.greatest(c["l"], r["l"]) + 1
        logical = (
            F.when(r.isNull(), F.when(wall == c["w"], c["l"] + 1).otherwise(F.lit(0)))
            .when((wall == c["w"]) & (wall == r["w"]), both)
            .when(wall == c["w"], c["l"] + 1)
            .when(wall == r["w"], r["l"] + 1)
            .otherwise(F.lit(0))
        )
        return hlc(wall, logical, c["n"])

    return F.aggregate(events, start, step)


@dataclass(order=True, frozen=True)
class Stamp:
    w: int = 0
    l: int = 0  # noqa: E741
    n: str = ""

    def __str__(self) -> str:
        return f"{self.w}:{self.l}:{self.n}"


class Clock:
    """One node's clock, for drivers and state processors; physical time is given, so runs repeat."""

    def __init__(self, node: str) -> None:
        self.now_ = Stamp(0, 0, node)

    def reserve(self, n: int, phys: int) -> Stamp:
        w, l = (phys, 0) if phys > self.now_.w else (self.now_.w, self.now_.l)
        out = Stamp(w, l, self.now_.n)
        self.now_ = Stamp(w, l + n, out.n)
        return out

    def now(self, phys: int) -> Stamp:
        return self.reserve(1, phys)

    def update(self, remote: Stamp, phys: int) -> Stamp:
        here, w = self.now_, max(self.now_.w, remote.w, phys)
        tied = [s.l for s in (here, remote) if s.w == w]
        self.now_ = Stamp(w, max(tied) + 1 if tied else 0, here.n)
        return self.now_
