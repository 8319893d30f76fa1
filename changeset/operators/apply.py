"""Applying patches: one static patch to every row, or a table with a patch for each entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import conditions as C
from ..functions.canon import comparable
from ..functions.paths import Found, PathError, delete_at, literal, parse, resolve, set_at
from ..functions.schema import IGNORE, READONLY, tagged
from .ops import Operation, Patch, op_table

#: Operations after which the state is put into a projection of its own, so that expressions stay small.
DEPTH = 40
_TEXT = "string"


class State:
    """A Column for each top-level field, as the operations so far leave it."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema = schema
        self.columns: dict[str, Column] = {f.name: F.col(f"`{f.name}`") for f in schema}

    def find(self, path: str) -> Found:
        tokens = parse(path)
        if not tokens:
            return Found(F.struct(*[self.columns[f.name].alias(f.name) for f in self.schema]), self.schema, F.lit(True))
        if tokens[0] not in self.columns:
            raise PathError(f"{path}: no such field")
        return resolve(self.columns[tokens[0]], self.schema[tokens[0]].dataType, tokens[1:])

    def tag(self, path: str, tag: str) -> bool:
        tokens = parse(path)
        return bool(tokens) and tokens[0] in self.columns and tagged(self.schema[tokens[0]], tag)

    def put(self, path: str, value: Column) -> tuple[dict[str, Column], Column]:
        tokens = parse(path)
        if not tokens:
            return {f.name: value.getField(f.name) for f in self.schema}, F.lit(None).cast(_TEXT)
        if tokens[0] not in self.columns:
            raise PathError(f"{path}: no such field")
        new, error = set_at(self.columns[tokens[0]], self.schema[tokens[0]].dataType, tokens[1:], value, f"/{tokens[0]}")
        return {tokens[0]: new}, error

    def drop(self, path: str, zero: bool) -> tuple[dict[str, Column], Column]:
        from ..functions.paths import zero_of

        tokens = parse(path)
        if not tokens:
            return {}, F.lit("/: the root can't be removed")
        if tokens[0] not in self.columns:
            raise PathError(f"{path}: no such field")
        dtype = self.schema[tokens[0]].dataType
        if len(tokens) == 1:
            return {tokens[0]: zero_of(dtype) if zero else F.lit(None).cast(dtype)}, F.lit(None).cast(_TEXT)
        new, error = delete_at(self.columns[tokens[0]], dtype, tokens[1:], f"/{tokens[0]}", zero)
        return {tokens[0]: new}, error


Resolver = Callable[[str, str, Column, Column], Column]


def _step(state: State, source: State, op: Operation, strict: bool, zero: bool, resolver: Resolver | None) -> tuple[dict[str, Column], Column, Column, Column]:
    """(changed columns, whether the op goes ahead, error or null, log line or null); the changes hold where it goes ahead without error."""
    none = F.lit(None).cast(_TEXT)
    gate = C.gate(*[None if c is None else C.compile_condition(c, source.find) for c in (op.if_, op.unless)])
    if op.kind == "log":
        return {}, gate, none, F.when(gate, literal(op.new, T.StringType()))
    if any(state.tag(p, IGNORE) for p in op.writes()):
        return {}, F.lit(False), none, none
    if any(state.tag(p, READONLY) for p in op.writes()):
        return {}, gate, F.lit(f"{op.path}: field is read-only"), none
    try:
        error = none
        if strict and op.kind in ("replace", "remove"):
            try:
                have = source.find(op.path)
            except PathError:
                return {}, gate, F.lit(f"{op.path}: strict check can't find the value"), none
            want = literal(op.old, have.dtype)
            same = comparable(have.value, have.dtype).eqNullSafe(comparable(want, have.dtype))
            error = F.when(~F.coalesce(have.present, F.lit(False)), F.lit(f"{op.path}: strict check can't find the value")).when(~same, F.lit(f"{op.path}: strict check failed"))
        if op.kind in ("add", "replace"):
            kind = state.find(op.path).dtype
            value = literal(op.new, kind)
            if resolver:
                value = resolver(op.path, op.kind, source.find(op.path).value, value)
            changed, own = state.put(op.path, value)
        elif op.kind == "custom":
            have = source.find(op.path)
            if strict and (fine := op.checked(have.value)) is not None:
                error = F.when(~F.coalesce(fine, F.lit(False)), F.lit(f"{op.path}: strict check failed"))
            value = op.applied(have.value)
            changed, own = state.put(op.path, resolver(op.path, op.kind, have.value, value) if resolver else value)
        elif op.kind == "remove":
            changed, own = state.drop(op.path, zero)
            if resolver:
                have = state.find(op.path)
                kept = resolver(op.path, op.kind, have.value, F.lit(None).cast(have.dtype))
                put, wrong = state.put(op.path, kept)
                changed, own = {n: F.when(kept.isNotNull(), put[n]).otherwise(c) for n, c in changed.items()}, F.when(kept.isNotNull(), wrong).otherwise(own)
        else:
            found = source.find(op.from_path)
            kind = state.find(op.path).dtype
            missing = F.when(~F.coalesce(found.present, F.lit(False)), F.lit(f"{op.from_path}: there is no value"))
            value = found.value if found.dtype == kind else found.value.try_cast(kind)
            changed, own = {}, none
            taken = F.lit(True)
            if resolver:
                settled = resolver(op.path, op.kind, source.find(op.path).value, value)
                value, taken = settled, settled.eqNullSafe(value)
            if op.kind == "move":
                changed, own = state.drop(op.from_path, zero)
                if resolver:  # a value that isn't let go stays where it was
                    changed, own = {n: F.when(taken, c).otherwise(state.columns[n]) for n, c in changed.items()}, F.when(taken, own)
            after = State(state.schema)
            after.columns = {**state.columns, **changed}
            more, last = after.put(op.path, value)
            changed, own = {**changed, **more}, F.coalesce(missing, own, last)
        return changed, gate, F.coalesce(error, own), none
    except PathError as e:
        return {}, gate, F.lit(str(e)), none


def apply_static(
    df: DataFrame, patch: Patch, mode: str = "sequential", zero_values: bool = False, resolver: Resolver | None = None, on_guard_fail: str = "keep", schema: T.StructType | None = None, table_id: str | None = None
) -> DataFrame:
    """One patch on every row, as projections without a shuffle. Adds status, errors, log.

    sequential: each operation sees what the earlier ones left. simultaneous: all read the row as it
    was, so a = b, b = a swaps; an explicit write to a path beats its removal as the source of a move.
    An operation that fails leaves its row as it is and its message in errors; later ones still run.
    status: ok, error, guard_failed or guard_error; on_guard_fail drop filters rows out before (the
    guard then reaches the scan). schema: the row's with field metadata, if df has none.
    resolver(path, kind, current, proposed) gives the value that is set: of a remove, whose proposal is null, a value
    keeps the place; a move whose proposal isn't taken as it is leaves its source.
    """
    if table_id is not None and patch.table_id not in (None, table_id):
        raise ValueError(f"the patch is for {patch.table_id}, not {table_id}")
    state = State(schema or df.schema)
    names = [f.name for f in state.schema]
    guard = None if patch.guard is None else C.compile_condition(patch.guard, state.find)
    if guard is not None and on_guard_fail == "drop":
        df, guard = df.where(F.coalesce(guard, F.lit(False))), None
    df = df.select(*[F.col(f"`{n}`") for n in names], C.guard_status(guard).alias("_guard"), F.array().cast("array<string>").alias("_errors"), F.array().cast("array<string>").alias("_log"))
    free = F.col("_guard").isNull()
    errors, logs = [], []
    written: set[str] = set()
    source = state
    if mode == "simultaneous":
        source = State(state.schema)
        explicit = {o.path for o in patch.ops if o.kind in ("add", "replace", "move", "copy")}
        ops = sorted(enumerate(patch.ops), key=lambda x: (x[1].kind == "move", x[0]))
        # Removals of move sources come first, so that a write to the same path wins.
        cleared = [Operation("remove", o.from_path, if_=o.if_, unless=o.unless) for o in patch.ops if o.kind == "move" and o.from_path not in explicit]
        steps = [*cleared, *[Operation("copy", o.path, from_path=o.from_path, if_=o.if_, unless=o.unless) if o.kind == "move" else o for _, o in sorted(ops)]]
    else:
        steps = list(patch.ops)

    def flush(df: DataFrame) -> DataFrame:
        own = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else F.array().cast("array<string>")
        out = df.select(*[state.columns[n].alias(n) for n in names], "_guard", F.concat("_errors", own(errors)).alias("_errors"), F.concat("_log", own(logs)).alias("_log"))
        state.columns = {n: F.col(f"`{n}`") for n in names}
        errors.clear(), logs.clear(), written.clear()
        return out

    for op in steps:
        # A projection for every second write of one column keeps the expression linear in the operations.
        if mode == "sequential" and (len(errors) + len(logs) >= DEPTH or written & {parse(p)[0] for p in (*op.reads(), *op.writes()) if parse(p)}):
            df = flush(df)
        changed, gate, error, line = _step(state, source, op, patch.strict, zero_values, resolver)
        ahead = gate & free
        errors.append(F.when(ahead, error))
        logs.append(F.when(free, line))
        for name, new in changed.items():
            state.columns[name] = F.when(ahead & error.isNull(), new).otherwise(state.columns[name])
            written.add(name)
    df = flush(df)
    status = F.coalesce("_guard", F.when(F.size("_errors") > 0, "error").otherwise("ok"))
    return df.select(*[F.col(f"`{n}`") for n in names], status.alias("status"), F.col("_errors").alias("errors"), F.col("_log").alias("log"))


def deliver_logs(result: DataFrame, key: list[str], callback: Callable[[tuple, str], None]) -> None:
    """Hands each log line of an applied table, with its entity's key, to a callback on the driver, a partition at a time."""
    for row in result.select(*key, F.explode("log").alias("_line")).toLocalIterator():
        callback(tuple(row[k] for k in key), row["_line"])


def report(errors: Column) -> Column:
    """Null for none, one error as it is, more under a heading."""
    return F.when(F.size(errors) == 1, F.get(errors, 0)).when(F.size(errors) > 1, F.concat(F.size(errors).cast("string"), F.lit(" errors:\n- "), F.array_join(errors, "\n- ")))


def read_json(text: Column, dtype: T.DataType) -> Column:
    """Canonical JSON text as a scalar; null for null and for what has no such value."""
    if isinstance(dtype, T.StringType):
        return F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).otherwise(F.when(text != "null", text))
    return F.trim(F.translate(text, '"', "")).try_cast(dtype)


def whole_row(op: Callable[[str], Column]) -> Column:
    """Whether an op inserts, replaces or deletes its entity's row: a plain write at the root, with an object for a value."""
    plain = ~F.coalesce(op("strict"), F.lit(False)) & (F.coalesce(op("if_cond"), op("unless_cond")).isNull())
    return op("path").isin("/", "") & plain & ((op("kind") == "remove") | (op("kind").isin("add", "replace") & F.coalesce(op("new").startswith("{"), F.lit(False))))


def _readable(dtype: T.DataType) -> bool:
    """Whether from_json reads it: no map has keys other than text."""
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, T.StringType) and _readable(dtype.valueType)
    if isinstance(dtype, T.ArrayType):
        return _readable(dtype.elementType)
    return not isinstance(dtype, T.StructType) or all(_readable(f.dataType) for f in dtype)


def _row_field(row: Column, f: T.StructField, old: Column) -> Column:
    """A field after a whole-row op (kind, new): the row text's value, null once deleted; read-only and ignored fields of rows that were there stay."""
    if not _readable(f.dataType):
        value = F.raise_error(F.lit(f"/{f.name}: maps with keys other than text can't be read from a row's text")).cast(f.dataType)
    else:
        value = F.from_json(row["new"], T.StructType([T.StructField(f.name, f.dataType)]))[f.name]
    value = F.when(row["kind"] != "remove", value)
    return F.when(F.col("_had"), old).otherwise(value) if tagged(f, READONLY) or tagged(f, IGNORE) else value


def _with_rows(df: DataFrame, own: DataFrame, key: list[str]) -> DataFrame:
    """df joined with its entities' ops: rows that the last whole-row op (_row) deletes go, those that it inserts come."""
    done = df.withColumn("_had", F.lit(True)).join(own, key, "full_outer").withColumn("_had", F.coalesce("_had", F.lit(False)))
    return done.where(F.when(F.col("_row").isNull(), F.col("_had")).otherwise(F.col("_row.kind") != "remove"))


def apply_writes(df: DataFrame, ops: DataFrame, key: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Patch tables of plain writes: add, replace and remove of rows and at top-level scalar fields, not strict, without conditions.

    The last write of each path counts, so entities' operations needn't be gathered: a partially
    aggregated maximum for each field and one join, whatever the number of operations of an entity.
    Adds status and errors; operations of other kinds or at other paths are errors, a message for each.
    An add or replace at / inserts the entity's row or replaces it, a remove deletes it; later writes
    don't bring a deleted row back. Field operations of entities without a row have nowhere to show.
    """
    schema = schema or df.schema
    scalar = [f for f in schema if f.name not in key and not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    open_ = [f for f in scalar if not tagged(f, READONLY) and not tagged(f, IGNORE)]
    plain = op_table(ops, key).where("kind <> 'log'")
    path, gone = F.col("path"), F.col("kind") == "remove"
    writes = F.col("kind").isin("add", "replace", "remove") & ~F.coalesce("strict", F.lit(False)) & F.col("if_cond").isNull() & F.col("unless_cond").isNull()
    at = lambda fields: path.isin(*[f"/{f.name}" for f in fields]) if fields else F.lit(False)
    fixed, hidden = [f for f in scalar if tagged(f, READONLY)], [f for f in scalar if tagged(f, IGNORE)]
    whole = whole_row(F.col)
    error = F.when(at(hidden) | whole, F.lit(None)).when(at(fixed), F.concat(path, F.lit(": field is read-only"))).when(~at(scalar), F.concat(path, F.lit(": no such field"))).when(~writes, F.concat(path, F.lit(": not a plain write")))
    last = lambda f: F.max(F.when(writes & (path == f"/{f.name}"), F.struct("seq", F.when(~gone, F.col("new")).alias("new"))))
    own = plain.groupBy(*key).agg(*[last(f).alias(f"_{f.name}") for f in open_], F.max(F.when(whole, F.struct("seq", "kind", "new"))).alias("_row"), F.array_sort(F.collect_set(error)).alias("_errors"))
    done = _with_rows(df, own, key)
    row = F.col("_row")
    new = {f.name: F.when(row.isNotNull(), _row_field(row, f, F.col(f"`{f.name}`"))).otherwise(F.col(f"`{f.name}`")) for f in schema if f.name not in key}
    counts = lambda f: F.col(f"_{f.name}").isNotNull() & (row.isNull() | (F.col(f"_{f.name}")["seq"] > row["seq"]))
    new |= {f.name: F.when(counts(f), read_json(F.col(f"_{f.name}")["new"], f.dataType)).otherwise(new[f.name]) for f in open_}
    errors = F.coalesce("_errors", F.array().cast("array<string>"))
    return done.select(*key, *[new[f.name].alias(f.name) for f in schema if f.name not in key], F.when(F.size(errors) > 0, "error").otherwise("ok").alias("status"), errors.alias("errors"))


def apply_table(df: DataFrame, ops: DataFrame, key: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Each entity's own operations in order of seq; one shuffle of the op rows and one join.

    Operations may add, replace, remove, move, copy and log at top-level scalar fields, strictly or
    not: a fold over the entity's sorted ops, in JVM expressions. Op tables with conditions or
    nested paths go to apply_table_general, plain writes only to apply_writes. Adds status and errors; entities without ops are ok.
    An add or replace at / inserts the entity's row or replaces it, a remove deletes it, as in apply_writes.
    """
    schema = schema or df.schema
    fields = [f for f in schema if f.name not in key]
    scalar = [f for f in fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    row = F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in scalar])
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in scalar] + [T.StructField("_errors", T.ArrayType(T.StringType()))])
    whole = whole_row(F.col)
    own = op_table(ops, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "path", "from_path", "old", "new", "strict", whole.alias("whole")))).alias("_ops"), F.max(F.when(whole, F.struct("seq", "kind", "new"))).alias("_row"))

    def fold(acc: Column, op: Column) -> Column:
        out = {f.name: acc[f.name] for f in scalar}
        paths = {f.name: F.lit(f"/{f.name}") for f in scalar}
        where = lambda f, c="path": op[c] == paths[f.name]
        text_of = F.lit(None).cast("string")
        known, known_from, read_only, ignored, strict_bad = (F.lit(False),) * 5
        for f in scalar:
            known, known_from = known | where(f), known_from | F.coalesce(where(f, "from_path"), F.lit(False))
            text_of = F.when(where(f, "from_path"), acc[f.name].cast("string")).otherwise(text_of)
            if tagged(f, READONLY):
                read_only = read_only | where(f)
            if tagged(f, IGNORE):
                ignored = ignored | where(f)
            strict_bad = strict_bad | (where(f) & ~acc[f.name].eqNullSafe(read_json(op["old"], f.dataType)))
        shifts = op["kind"].isin("move", "copy")
        error = (
            F.when((op["kind"] == "log") | ignored | op["whole"], F.lit(None).cast("string"))
            .when(read_only, F.concat(op["path"], F.lit(": field is read-only")))
            .when(~known, F.concat(op["path"], F.lit(": no such field")))
            .when(shifts & ~known_from, F.concat(F.coalesce(op["from_path"], F.lit("null")), F.lit(": no such field")))
            .when(F.coalesce(op["strict"], F.lit(False)) & op["kind"].isin("replace", "remove") & strict_bad, F.concat(op["path"], F.lit(": strict check failed")))
        )
        good = error.isNull() & (op["kind"] != "log") & ~ignored
        for f in scalar:
            value = F.when(op["kind"].isin("add", "replace"), read_json(op["new"], f.dataType)).when(shifts, text_of.try_cast(f.dataType))
            gone = (op["kind"] == "move") & F.coalesce(where(f, "from_path"), F.lit(False)) & ~where(f)
            out[f.name] = F.when(op["whole"], _row_field(op, f, acc[f.name])).when(good & where(f), value).when(good & gone, F.lit(None).cast(f.dataType)).otherwise(acc[f.name])
        errors = F.when(error.isNotNull(), F.array_append(acc["_errors"], error)).otherwise(acc["_errors"])
        return F.struct(*[out[f.name].alias(f.name) for f in scalar], errors.alias("_errors")).cast(kinds)

    start = row.withField("_errors", F.array().cast("array<string>")).cast(kinds)
    done = _with_rows(df, own, key).withColumn("_new", F.when(F.col("_ops").isNotNull(), F.aggregate("_ops", start, fold)).otherwise(start))
    cols = [F.col(f"_new.`{f.name}`").alias(f.name) if f in scalar else F.when(F.col("_row").isNotNull(), _row_field(F.col("_row"), f, F.col(f"`{f.name}`"))).otherwise(F.col(f"`{f.name}`")).alias(f.name) for f in schema if f.name not in key]
    errors = F.col("_new._errors")
    return done.select(*key, *cols, F.when(F.size(errors) > 0, "error").otherwise("ok").alias("status"), errors.alias("errors"))


def apply_table_general(df: DataFrame, ops: DataFrame, key: list[str], schema: T.StructType | None = None, guard: C.Condition | None = None) -> DataFrame:
    """As apply_table, with conditions and nested paths of any depth: an interpreter over Arrow batches, for what has no JVM form."""
    from .interpret import interpreter

    schema = schema or df.schema
    own = op_table(ops, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("seq", "kind", "path", "from_path", "old", "new", "if_cond", "unless_cond", "strict")]))).alias("_ops"))
    out = T.StructType([*schema.fields, T.StructField("status", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("log", T.ArrayType(T.StringType()))])
    return df.select(*schema.names).join(own, key, "left").mapInArrow(interpreter(schema, key, guard), out)
