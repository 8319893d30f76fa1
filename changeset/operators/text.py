"""Collaborative text: runs of bytes that name their predecessor.

A run is {id: hlc, v: text, p: hlc of the byte before it, d: deleted}; the byte at offset k of a run
has the run's id with l + k. All offsets count bytes of UTF-8.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = "struct<id:struct<w:bigint,l:int,n:string>,v:string,p:struct<w:bigint,l:int,n:string>,d:boolean>"
Id = tuple[int, int, str]
ZERO: Id = (0, 0, "")


class Run:
    __slots__ = ("d", "id", "p", "v")

    def __init__(self, id: Id, v: bytes, p: Id, d: bool) -> None:
        self.id, self.v, self.p, self.d = id, v, p, d

    def key(self):
        return (self.id, self.v, self.p, self.d)

    def last(self) -> Id:
        return (self.id[0], self.id[1] + max(len(self.v), 1) - 1, self.id[2])


def ordered(runs: Iterable[Run]) -> tuple[list[Run], list[Run]]:
    """(runs in reading order, orphans): below each byte its followers, newest id first, depth first from the zero id.
    Orphans have a predecessor that hasn't come yet; they are kept and not shown."""
    after: dict[Id, list[Run]] = defaultdict(list)
    for r in runs:
        after[r.p].append(r)
    out: list[Run] = []
    seen: set[int] = set()
    todo = sorted(after.get(ZERO, ()), key=lambda r: r.id)
    while todo:
        item = todo.pop()
        if id(item) in seen:
            continue
        seen.add(id(item))
        out.append(item)
        # A run is never followed from its middle: split runs before ordering them.
        todo += sorted(after.get(item.last(), ()), key=lambda r: r.id)
    return out, [r for r in runs if id(r) not in seen]


def split_all(runs: Iterable[Run]) -> list[Run]:
    """Runs cut wherever another run of the same wall and node begins, or a follower hangs on; pieces of equal id are one, deleted if any is."""
    runs = list(runs)
    cuts: dict[tuple[int, str], set[int]] = defaultdict(set)
    for r in runs:
        cuts[r.id[0], r.id[2]] |= {r.id[1], r.id[1] + len(r.v)}
        cuts[r.p[0], r.p[2]].add(r.p[1] + 1)
    pieces: dict[Id, Run] = {}
    for r in runs:
        w, l, n = r.id
        at = [0, *sorted(c - l for c in cuts[w, n] if 0 < c - l < len(r.v)), len(r.v)]
        for a, b in zip(at, at[1:], strict=False) if len(r.v) else [(0, 0)]:
            own = (w, l + a, n)
            if own in pieces:
                pieces[own].d = pieces[own].d or r.d
            else:
                pieces[own] = Run(own, r.v[a:b], r.p if a == 0 else (w, l + a - 1, n), r.d)
    return list(pieces.values())


def joined(runs: list[Run]) -> list[Run]:
    """Neighbours that continue each other as one run."""
    out: list[Run] = []
    for r in runs:
        if out and out[-1].d == r.d and out[-1].id[0] == r.id[0] and out[-1].id[2] == r.id[2] and out[-1].id[1] + len(out[-1].v) == r.id[1] and r.p == out[-1].last():
            out[-1] = Run(out[-1].id, out[-1].v + r.v, out[-1].p, r.d)
        else:
            out.append(Run(r.id, r.v, r.p, r.d))
    return out


def merge(*sides: Iterable[Run]) -> list[Run]:
    """The union of run sets, in reading order, orphans last."""
    pieces = split_all(r for s in sides for r in s)
    shown, orphans = ordered(sorted(pieces, key=Run.key))
    return joined(shown) + joined(sorted(orphans, key=Run.key))


def render(runs: Iterable[Run]) -> str:
    shown, _ = ordered(split_all(runs))
    return b"".join(r.v for r in shown if not r.d).decode("utf-8", "replace")


def insert(runs: list[Run], pos: int, text: bytes, id: Id) -> list[Run]:
    """Inserts before the visible byte pos; id is the first of len(text) that a clock has reserved."""
    if not text:
        return runs
    before = ZERO
    left = pos
    shown, _ = ordered(split_all(runs))
    for r in shown:
        if not r.d and left > 0:
            step = min(left, len(r.v))
            before = (r.id[0], r.id[1] + step - 1, r.id[2])
            left -= step
    return merge(runs, [Run(id, text, before, False)])


def delete(runs: list[Run], pos: int, length: int) -> list[Run]:
    """Marks the visible bytes pos to pos + length."""
    out, at = [], 0
    shown, orphans = ordered(split_all(runs))
    for r in shown:
        if r.d:
            out.append(r)
            continue
        a, b = max(0, pos - at), min(len(r.v), pos + length - at)
        at += len(r.v)
        if a >= b:
            out.append(r)
            continue
        w, l, n = r.id
        for i, j, d in ((0, a, False), (a, b, True), (b, len(r.v), False)):
            if i < j:
                out.append(Run((w, l + i, n), r.v[i:j], r.p if i == 0 else (w, l + i - 1, n), d))
    return merge(out, orphans)


def to_runs(rows: Iterable[dict] | None) -> list[Run]:
    stamp = lambda s: ZERO if s is None else (s["w"] or 0, s["l"] or 0, s["n"] or "")
    return [Run(stamp(r["id"]), (r["v"] or "").encode(), stamp(r["p"]), bool(r["d"])) for r in rows or ()]


def from_runs(runs: Iterable[Run]) -> list[dict]:
    stamp = lambda s: dict(zip("wln", s, strict=True))
    return [{"id": stamp(r.id), "v": r.v.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), "p": stamp(r.p), "d": r.d} for r in runs]


_STAMP = pa.struct([("w", pa.int64()), ("l", pa.int32()), ("n", pa.string())])
ARROW_RUNS = pa.list_(pa.struct([("id", _STAMP), ("v", pa.string()), ("p", _STAMP), ("d", pa.bool_())]))


def _by_document(runs: DataFrame, key: list[str]) -> DataFrame:
    """key, runs: a document's runs are one value, as its text is."""
    return runs.groupBy(*key).agg(F.collect_set(F.struct(F.col("id"), F.col("v"), F.col("p"), F.col("d")).cast(RUN)).alias("runs"))


def _kinds(df: DataFrame, key: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)


def render_text(runs: DataFrame, key: list[str]) -> DataFrame:
    """key, text from run rows (key, id, v, p, d) in any order, repeated or not."""
    docs = _by_document(runs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array([render(to_runs(r)) for r in batch.column("runs").to_pylist()], pa.string())], [*key, "text"])

    return docs.mapInArrow(run, f"{_kinds(docs, key)}, text string")


def merge_text(runs: DataFrame, key: list[str]) -> DataFrame:
    """key, runs (array in reading order, orphans last): the merged state of all replicas' run rows."""
    docs = _by_document(runs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array([from_runs(merge(to_runs(r))) for r in batch.column("runs").to_pylist()], ARROW_RUNS)], [*key, "runs"])

    return docs.mapInArrow(run, f"{_kinds(docs, key)}, runs array<{RUN}>")


def edit_text(states: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """key, runs after local edits. states: key, runs; edits: key, seq, kind (insert or delete), pos, length, v, id (of an insert)."""
    own = edits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "pos", "length", "v", "id"))).alias("_edits"))
    both = states.select(*key, "runs").join(own, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, todo in zip(batch.column("runs").to_pylist(), batch.column("_edits").to_pylist(), strict=True):
                runs = to_runs(rows)
                for e in todo or ():
                    runs = insert(runs, e["pos"], e["v"].encode(), (e["id"]["w"], e["id"]["l"], e["id"]["n"])) if e["kind"] == "insert" else delete(runs, e["pos"], e["length"])
                out.append(from_runs(runs))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(out, ARROW_RUNS)], [*key, "runs"])

    return both.mapInArrow(run, f"{_kinds(both, key)}, runs array<{RUN}>")


def merge_tombstones(runs: DataFrame, key: list[str]) -> DataFrame:
    """Run rows by id, deleted if any replica says so: the merge where replicas cut their runs alike, in the JVM."""
    return runs.groupBy(*key, "id").agg(F.min("v").alias("v"), F.min("p").alias("p"), F.bool_or("d").alias("d"))


def is_text(dtype: T.DataType) -> bool:
    """Whether a field holds text runs."""
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType) and dtype.elementType.names == ["id", "v", "p", "d"]


def text_ancestor(schema: T.StructType, path: str) -> str | None:
    """The path of the text field at or above a path, by the schema alone."""
    from ..functions.paths import join, parse

    here: T.DataType = schema
    tokens = parse(path)
    for i, t in enumerate(tokens):
        if isinstance(here, T.StructType) and t in here.names:
            here = here[t].dataType
        elif isinstance(here, T.MapType):
            here = here.valueType
        elif isinstance(here, T.ArrayType):
            here = here.elementType
        else:
            return None
        if is_text(here):
            return join(tokens[: i + 1])
    return None
