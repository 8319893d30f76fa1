"""Shortest edit scripts between two lists."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCRIPT = "array<struct<kind:string,at:int,old:string,new:string>>"


def _further(x: Sequence, y: Sequence, low: int, row: Sequence[int]) -> tuple[int, array]:
    """A search's next round, of one edit more: its lowest diagonal (place in x less place in y) and, of that and every second one
    above, the furthest place in x. Outer diagonals that have left the lists are dropped: every place on them is reached."""
    n, m, out = len(x), len(y), array("q")
    for k, below, above in zip(range(low - 1, low + 2 * len(row), 2), chain((-1,), row), chain(row, (-1,)), strict=True):
        i = below + 1 if below >= above else above
        while i < n and i - k < m and x[i] == y[i - k]:
            i += 1
        out.append(i)
    low -= 1
    while out and out[-1] > n:
        out.pop()
    gone = next((s for s, i in enumerate(out) if i - (low + 2 * s) <= m), len(out))
    return low + 2 * gone, out[gone:]


def _reached(edits: int, low: int, row: Sequence[int], k: int, i: int) -> bool:
    """Whether a round has come to place i of diagonal k."""
    s = (k - low) // 2
    return abs(k) <= edits and (not 0 <= s < len(row) or row[s] >= i)


def shortest(a: Sequence, b: Sequence) -> list[tuple[str, int, object, object]]:
    """(remove, position in a, value, None) and (add, position in b, None, value), as few as possible, in order of place.

    Of several shortest scripts it is the first: at every place an equal value is kept, else one is removed if that leaves
    a shortest script, else one is added. Searches from the ends, then walks from the starts by what is left to the ends.
    Rounds 0, 1, 3, 6, 10 and so on are kept and those between searched again, so memory grows with the edits to the power 1.5.
    """
    n, m = len(a), len(b)
    i = next((i for i, (v, w) in enumerate(zip(a, b, strict=False)) if v != w), min(n, m))
    x, y, j = a[i:][::-1], b[i:][::-1], i
    same = next((k for k, (v, w) in enumerate(zip(x, y, strict=False)) if v != w), min(len(x), len(y)))
    edits, now, kept = 0, (0, array("q", [same])), []
    while (n - m - edits) % 2 or not _reached(edits, *now, n - m, n - i):
        if edits == len(kept) * (len(kept) + 1) // 2:
            kept.append(now)
        edits, now = edits + 1, _further(x, y, *now)
    out, first, rounds = [], edits, []
    while edits:
        while i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        edits -= 1
        if edits < first:
            rounds = [kept.pop()]
            first = len(kept) * (len(kept) + 1) // 2
            while first + len(rounds) <= edits:
                rounds.append(_further(x, y, *rounds[-1]))
        left = n - i - 1
        if i < n and _reached(edits, *rounds[edits - first], left - (m - j), left):
            out.append(("remove", i, a[i], None))
            i += 1
        else:
            out.append(("add", j, None, b[j]))
            j += 1
    return out


def run_script(a: Sequence, script: list[tuple[str, int, object, object]]) -> list:
    """The list after a script: removals by positions in a, additions by positions in the result."""
    gone = {at for kind, at, _, _ in script if kind == "remove"}
    left = iter([v for i, v in enumerate(a) if i not in gone])
    adds = {at: new for kind, at, _, new in script if kind == "add"}
    n = len(a) - len(gone) + len(adds)
    return [adds[i] if i in adds else next(left) for i in range(n)]


def edit_scripts(df: DataFrame, key: list[str], before: str, after: str) -> DataFrame:
    """key, script for two columns of string lists; null lists count as empty. Equal pairs are told in the JVM and never reach Python."""
    own = df.select(*key, before, after)
    same = F.coalesce(F.col(before), F.array().cast("array<string>")) == F.coalesce(F.col(after), F.array().cast("array<string>"))
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(before).to_pylist(), batch.column(after).to_pylist(), strict=True):
                out.append([{"kind": k, "at": i, "old": o, "new": v} for k, i, o, v in shortest(a or [], b or [])])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("old", pa.string()), ("new", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(out, kind)], [*key, "script"])

    return own.where(~same).mapInArrow(run, f"{kinds}, script {SCRIPT}").unionByName(own.where(same).select(*key, F.array().cast(SCRIPT).alias("script")))


def apply_scripts(df: DataFrame, key: list[str], column: str, script: str) -> DataFrame:
    """key and column, a list of strings, after its script; null lists count as empty."""
    own = df.select(*key, column, script)
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [run_script(a or [], [(e["kind"], e["at"], e["old"], e["new"]) for e in s or ()]) for a, s in zip(batch.column(column).to_pylist(), batch.column(script).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(out, pa.list_(pa.string()))], [*key, column])

    return own.mapInArrow(run, f"{kinds}, `{column}` array<string>")


def shifted_positions(ops: DataFrame, lists: list[str], order: str) -> DataFrame:
    """Adds position: at of an edit as it is when the edits are run one after another: earlier additions move it up, removals down."""
    line = Window.partitionBy(*lists).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.when(F.col("kind") == "add", 1).when(F.col("kind") == "remove", -1).otherwise(0)).over(line), F.lit(0))
    return ops.withColumn("position", F.when(F.col("kind") == "remove", F.col("at") + moved).otherwise(F.col("at")).cast("int"))
