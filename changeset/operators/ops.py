"""Operations, static patches, and patch tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import conditions as C
from ..functions.paths import parse, resolve

KINDS = ("add", "remove", "replace", "move", "copy", "log", "custom")
#: Columns of a patch table besides the entity's key; old and new hold canonical JSON text.
OP_COLUMNS = {"seq": "int", "kind": "string", "path": "string", "from_path": "string", "old": "string", "new": "string", "if_cond": "string", "unless_cond": "string", "strict": "boolean"}


@dataclass(frozen=True)
class Operation:
    kind: str
    path: str
    old: object = None
    new: object = None
    from_path: str | None = None
    if_: C.Condition | None = None
    unless: C.Condition | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")

    def when(self, cond: C.Condition) -> Operation:
        return replace(self, if_=cond)

    def except_when(self, cond: C.Condition) -> Operation:
        return replace(self, unless=cond)

    def reads(self) -> list[str]:
        found = [self.from_path] if self.from_path else []
        todo = [c for c in (self.if_, self.unless) if c]
        while todo:
            c = todo.pop()
            todo += c.sub
            found += [] if c.sub else [c.path]
        return found

    def writes(self) -> list[str]:
        return [] if self.kind == "log" else [self.path, *([self.from_path] if self.kind == "move" else [])]


def set_(path: str, value, old=None) -> Operation:
    return Operation("replace", path, old, value)


def add(path: str, value) -> Operation:
    return Operation("add", path, None, value)


def remove(path: str, old=None) -> Operation:
    return Operation("remove", path, old)


def move(source: str, path: str) -> Operation:
    return Operation("move", path, from_path=source)


def copy(source: str, path: str) -> Operation:
    return Operation("copy", path, from_path=source)


def log(message: str) -> Operation:
    return Operation("log", "/", new=message)


def _shown(v) -> str:
    return "null" if v is None else str(v)


@dataclass(frozen=True)
class Patch:
    """The same operations for every row. table_id names the table they are for."""

    ops: tuple[Operation, ...] = ()
    guard: C.Condition | None = None
    strict: bool = False
    table_id: str | None = None

    def is_empty(self) -> bool:
        return not self.ops

    def as_strict(self) -> Patch:
        return replace(self, strict=True)

    def with_guard(self, cond: C.Condition | None) -> Patch:
        return replace(self, guard=cond)

    def __str__(self) -> str:
        # The wording of the lines, here and in line_of.
        if not self.ops:
            return "No changes."
        line = {
            "add": lambda o: f"Add {o.path}: {_shown(o.new)}",
            "remove": lambda o: f"Remove {o.path} (was {_shown(o.old)})",
            "replace": lambda o: f"Replace {o.path}: {_shown(o.old)} -> {_shown(o.new)}",
            "move": lambda o: f"Move {o.from_path} to {o.path}",
            "copy": lambda o: f"Copy {o.from_path} to {o.path}",
            "log": lambda o: f"Log {o.path}: {_shown(o.new)}",
            "custom": lambda o: o.line(),
        }
        return "\n".join(line[o.kind](o) for o in self.ops)

    def reverse(self) -> Patch:
        """Undoes the patch: guards, conditions and log operations are not carried over."""
        back = {
            "add": lambda o: Operation("remove", o.path, o.new),
            "remove": lambda o: Operation("add", o.path, None, o.old),
            "replace": lambda o: Operation("replace", o.path, o.new, o.old),
            "move": lambda o: Operation("move", o.from_path, from_path=o.path),
            "copy": lambda o: Operation("remove", o.path),
            "custom": lambda o: o.reversed(),
        }
        return Patch(tuple(back[o.kind](o) for o in reversed(self.ops) if o.kind != "log"), strict=self.strict, table_id=self.table_id)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """The patch as op rows, without an entity key."""
        import json

        if any(o.kind == "custom" for o in self.ops):
            raise ValueError("an operation of the caller's own has no row")
        rows = [(i, o.kind, o.path, o.from_path, None if o.old is None else json.dumps(o.old), None if o.new is None else json.dumps(o.new), o.if_ and o.if_.to_json(), o.unless and o.unless.to_json(), self.strict) for i, o in enumerate(self.ops)]
        return spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in OP_COLUMNS.items()))


@dataclass
class Edit:
    """Builds a patch against a schema: paths that it lacks are refused."""

    schema: T.StructType
    ops: list[Operation] = field(default_factory=list)
    cond: C.Condition | None = None

    def _checked(self, path: str) -> None:
        if parse(path):
            resolve(F.lit(None), self.schema, parse(path))

    def with_(self, *ops: Operation) -> Edit:
        for o in ops:
            for path in (o.path, o.from_path):
                if path:
                    self._checked(path)
            self.ops.append(o)
        return self

    def log(self, message: str) -> Edit:
        return self.with_(log(message))

    def guard(self, cond: C.Condition) -> Edit:
        self.cond = C.and_(self.cond, cond) if self.cond else cond
        return self

    def build(self) -> Patch:
        return Patch(tuple(self.ops), self.cond)


def op_table(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows with all op columns; those that are missing are null (strict: false)."""
    have = set(df.columns)
    cols = [F.col(c).cast(kind) if c in have else F.lit(False if c == "strict" else None).cast(kind) for c, kind in OP_COLUMNS.items()]
    return df.select(*key, *[c.alias(n) for c, n in zip(cols, OP_COLUMNS, strict=True)])


def reverse_table(ops: DataFrame, key: list[str]) -> DataFrame:
    """Every entity's patch reversed; log rows are dropped, conditions not carried over."""
    real = op_table(ops, key).where("kind <> 'log'")
    top = F.max("seq").over(Window.partitionBy(*key))
    kind = F.expr("case kind when 'add' then 'remove' when 'remove' then 'add' when 'copy' then 'remove' else kind end")
    moved, copied = F.col("kind") == "move", F.col("kind") == "copy"
    return real.select(
        *key, (top - F.col("seq")).alias("seq"), kind.alias("kind"), F.when(moved, F.col("from_path")).otherwise(F.col("path")).alias("path"), F.when(moved, F.col("path")).alias("from_path"),
        F.when(~copied, F.col("new")).alias("old"), F.col("old").alias("new"), F.lit(None).cast("string").alias("if_cond"), F.lit(None).cast("string").alias("unless_cond"), "strict",
    )


def line_of(style: str = "patch") -> Column:
    """One op row as text; style summary: Added/Removed/Updated."""
    c = {n: F.coalesce(n, F.lit("null")) for n in ("path", "from_path", "old", "new")}
    kind = F.col("kind")
    if style == "summary":
        into_list = F.regexp_like("path", F.lit(r"/\d+$"))
        parent = F.regexp_replace("path", r"/\d+$", "")
        return (
            F.when((kind == "add") & into_list, F.concat(F.lit("Added to "), parent, F.lit(": "), c["new"]))
            .when(kind == "add", F.concat(F.lit("Added "), c["path"], F.lit(": "), c["new"]))
            .when((kind == "remove") & into_list, F.concat(F.lit("Removed from "), parent, F.lit(": "), c["old"]))
            .when(kind == "remove", F.concat(F.lit("Removed "), c["path"], F.lit(" (was "), c["old"], F.lit(")")))
            .when(kind == "replace", F.concat(F.lit("Updated "), c["path"], F.lit(" from "), c["old"], F.lit(" to "), c["new"]))
            .when(kind == "move", F.concat(F.lit("Moved "), c["from_path"], F.lit(" to "), c["path"]))
            .when(kind == "copy", F.concat(F.lit("Copied "), c["from_path"], F.lit(" to "), c["path"]))
            .otherwise(F.concat(F.lit("Logged "), c["new"]))
        )
    return (
        F.when(kind == "add", F.concat(F.lit("Add "), c["path"], F.lit(": "), c["new"]))
        .when(kind == "remove", F.concat(F.lit("Remove "), c["path"], F.lit(" (was "), c["old"], F.lit(")")))
        .when(kind == "replace", F.concat(F.lit("Replace "), c["path"], F.lit(": "), c["old"], F.lit(" -> "), c["new"]))
        .when(kind == "move", F.concat(F.lit("Move "), c["from_path"], F.lit(" to "), c["path"]))
        .when(kind == "copy", F.concat(F.lit("Copy "), c["from_path"], F.lit(" to "), c["path"]))
        .otherwise(F.concat(F.lit("Log "), c["path"], F.lit(": "), c["new"]))
    )


def render_table(ops: DataFrame, key: list[str], style: str = "patch") -> DataFrame:
    """key, text: each entity's operations, one line each, in order of seq."""
    lines = op_table(ops, key).select(*key, F.struct("seq", line_of(style).alias("line")).alias("x"))
    return lines.groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("x")).select(*key, F.array_join(F.col("x.line"), "\n").alias("text"))
