"""Wire formats of patches, deltas and replica states, as Column functions over op tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import from_predicate
from ..operators.ops import Operation, Patch, op_table

#: Numbers of the kinds in the native format.
KIND_NUMBERS = {"add": 0, "remove": 1, "replace": 2, "move": 3, "copy": 4, "log": 5}
_NAMES = {v: k for k, v in KIND_NUMBERS.items()}



# --- static patches, on the driver


def to_native(patch: Patch) -> str:
    """{cond, ops: [{k, p, o, n, if, un}], strict}; k is the kind's number. A move's or copy's o is its source path."""
    ops = []
    for o in patch.ops:
        row = {"k": KIND_NUMBERS[o.kind], "p": o.path}
        old = o.from_path if o.kind in ("move", "copy") else o.old
        row |= ({"o": old} if old is not None else {}) | ({"n": o.new} if o.new is not None else {})
        row |= ({"if": o.if_.to_predicate()} if o.if_ else {}) | ({"un": o.unless.to_predicate()} if o.unless else {})
        ops.append(row)
    out: dict = {"ops": ops}
    if patch.guard:
        out["cond"] = patch.guard.to_predicate()
    if patch.strict:
        out["strict"] = True
    return json.dumps(out)


def from_native(text: str) -> Patch:
    d = json.loads(text)
    ops = []
    for r in d.get("ops") or []:
        kind = _NAMES[r["k"]]
        shift = kind in ("move", "copy")
        if shift and not isinstance(r.get("o"), str):
            raise ValueError(f"{r['p']}: {kind} has no source path")
        conds = {n: from_predicate(r[k]) if r.get(k) else None for n, k in (("if_", "if"), ("unless", "un"))}
        ops.append(Operation(kind, r["p"], None if shift else r.get("o"), r.get("n"), r["o"] if shift else None, **conds))
    return Patch(tuple(ops), from_predicate(d["cond"]) if d.get("cond") else None, bool(d.get("strict")))


def to_json_patch(patch: Patch) -> str:
    """RFC 6902 with the extensions if, unless, and a leading test on / that holds the guard; [] for an empty patch. Old values and strict are not carried."""
    out: list[dict] = [{"op": "test", "path": "/", "if": patch.guard.to_predicate()}] if patch.guard else []
    for o in patch.ops:
        if o.kind == "custom":
            out.append(o.wire())
            continue
        row: dict = {"op": o.kind, "path": o.path}
        if o.kind in ("move", "copy"):
            row["from"] = o.from_path
        elif o.kind != "remove":
            row["value"] = o.new
        row |= ({"if": o.if_.to_predicate()} if o.if_ else {}) | ({"unless": o.unless.to_predicate()} if o.unless else {})
        out.append(row)
    return json.dumps(out)


def from_json_patch(text: str) -> Patch:
    """Other operations, tests elsewhere included, are skipped."""
    ops, guard = [], None
    for r in json.loads(text):
        if r.get("op") == "test" and r.get("path") in ("/", "") and r.get("if"):
            guard = from_predicate(r["if"])
        elif r.get("op") in KIND_NUMBERS:
            ops.append(Operation(r["op"], r["path"], None, r.get("value"), r.get("from"), from_predicate(r["if"]) if r.get("if") else None, from_predicate(r["unless"]) if r.get("unless") else None))
    return Patch(tuple(ops), guard)


# --- patch tables


def _member(name: str, text: Column) -> Column:
    """"name":<JSON text>, or null."""
    return F.when(text.isNotNull(), F.concat(F.lit(f'"{name}":'), text))


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def _texts(text: Column, fields: dict[str, str], values: list[str]) -> Column:
    """An array of JSON objects as structs of their members: fields by type, values as JSON text. A string type gives strings without
    their quotes and all else as it stands, so the values are read once more as variants, which tell strings from the rest."""
    plain = F.from_json(text, "array<struct<" + ",".join(f"`{n}`:{k}" for n, k in {**fields, **dict.fromkeys(values, "string")}.items()) + ">>")
    kinds = F.from_json(text, "array<struct<" + ",".join(f"`{n}`:variant" for n in values) + ">>")
    one = lambda x, y: F.struct(*[x[n].alias(n) for n in fields], *[F.when(F.schema_of_variant(y[n]) == "STRING", quoted(x[n])).otherwise(x[n]).alias(n) for n in values])
    return F.zip_with(plain, kinds, one)


def _native_rows(patches: DataFrame, keep: list[Column | str], ops: Column, strict: Column) -> DataFrame:
    """keep and op rows of a native patch's ops text."""
    x = _texts(ops, {"k": "int", "p": "string", "if": "string", "un": "string", "from": "string"}, ["o", "n"])
    source = F.from_json(ops, "array<struct<o:string>>")
    rows = patches.select(*keep, F.coalesce(strict, F.lit(False)).alias("strict"), F.posexplode(F.zip_with(x, source, lambda a, b: a.withField("from", b["o"]))).alias("seq", "x"))
    kind = F.coalesce(*[F.when(F.col("x.k") == v, F.lit(k)) for k, v in KIND_NUMBERS.items()])
    shift = kind.isin("move", "copy")
    names = [c for c in rows.columns if c not in ("strict", "seq", "x")]
    return rows.select(*names, "seq", kind.alias("kind"), F.col("x.p").alias("path"), F.when(shift, F.col("x.from")).alias("from_path"), F.when(~shift, F.col("x.o")).alias("old"), F.col("x.n").alias("new"), F.col("x.if").alias("if_cond"), F.col("x.un").alias("unless_cond"), "strict")


def _documents(ops: DataFrame, key: list[str], member: Column, name: str) -> DataFrame:
    """key, name: each entity's members as a JSON array, by seq. An entity's patch is one value on the wire, so its ops are gathered."""
    rows = ops.select(*key, F.struct("seq", member.alias("m")).alias("x"))
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("x")).select(*key, F.concat(F.lit("["), F.array_join(F.col("x.m"), ","), F.lit("]")).alias(name))


def table_to_json_patch(ops: DataFrame, key: list[str]) -> DataFrame:
    """key, patch: RFC 6902 text of each entity's ops. old, new are JSON text already."""
    o = op_table(ops, key)
    shift = F.col("kind").isin("move", "copy")
    value = F.when(~shift & (F.col("kind") != "remove"), F.coalesce("new", F.lit("null")))
    member = _object(_member("op", quoted(F.col("kind"))), _member("path", quoted(F.col("path"))), _member("from", F.when(shift, quoted(F.col("from_path")))), _member("value", value), _member("if", F.col("if_cond")), _member("unless", F.col("unless_cond")))
    return _documents(o, key, member, "patch")


def json_patch_to_table(patches: DataFrame, key: list[str], text: str = "patch") -> DataFrame:
    """Op rows of RFC 6902 texts; seq is the place in the text. A leading test on / becomes if_cond of no row but
    the column guard of all; unknown operations are skipped."""
    items = _texts(F.col(text), {"op": "string", "path": "string", "from": "string", "if": "string", "unless": "string"}, ["value"])
    guard = F.get(F.filter(items, lambda x: (x["op"] == "test") & x["path"].isin("/", "") & x["if"].isNotNull()), 0)["if"]
    rows = patches.select(*key, guard.alias("guard"), F.posexplode(items).alias("seq", "x")).where(F.col("x.op").isin(*KIND_NUMBERS))
    none = F.lit(None).cast("string")
    return rows.select(*key, "seq", F.col("x.op").alias("kind"), F.col("x.path").alias("path"), F.col("x.from").alias("from_path"), none.alias("old"), F.col("x.value").alias("new"), F.col("x.if").alias("if_cond"), F.col("x.unless").alias("unless_cond"), F.lit(False).alias("strict"), "guard")


def table_to_native(ops: DataFrame, key: list[str], guard: str | None = None) -> DataFrame:
    """key, patch: native JSON of each entity's ops."""
    o = op_table(ops, key)
    shift = F.col("kind").isin("move", "copy")
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(str(v))) for k, v in KIND_NUMBERS.items()])
    old = F.when(shift, quoted(F.col("from_path"))).otherwise(F.col("old"))
    member = _object(_member("k", number), _member("p", quoted(F.col("path"))), _member("o", old), _member("n", F.col("new")), _member("if", F.col("if_cond")), _member("un", F.col("unless_cond")))
    docs = _documents(o, key, member, "ops").join(o.groupBy(*key).agg(F.bool_or("strict").alias("strict")), key)
    return docs.select(*key, _object(_member("cond", F.lit(guard)), _member("ops", F.col("ops")), _member("strict", F.when(F.col("strict"), F.lit("true")))).alias("patch"))


def native_to_table(patches: DataFrame, key: list[str], text: str = "patch") -> DataFrame:
    """Op rows of native texts."""
    head = F.from_json(F.col(text), "ops string, strict boolean")
    return _native_rows(patches, key, head["ops"], head["strict"])


STAMP = "struct<w:bigint,l:int,n:string>"


def deltas_to_json(patches: DataFrame, key: list[str], stamp: str = "hlc", patch: str = "patch") -> DataFrame:
    """key, value: {p: patch, t: stamp}, one text for each delta; also the value format of streams."""
    return patches.select(*key, _object(_member("p", F.col(patch)), _member("t", F.to_json(stamp))).alias("value"))


def json_to_deltas(texts: DataFrame, keep: list[str], value: str = "value") -> DataFrame:
    """keep, op rows (conditions, strict and sources of moves too) and hlc of delta texts; works on streams."""
    d = F.from_json(F.col(value), f"p struct<ops:string,strict:boolean>, t {STAMP}")
    return _native_rows(texts, [*keep, d["t"].alias("hlc")], d["p"]["ops"], d["p"]["strict"])


def _member_text(name: Column, text: Column) -> Column:
    return F.concat(quoted(name), F.lit(":"), text)


def state_to_json(state: DataFrame, key: list[str], node: str) -> DataFrame:
    """key, snapshot: {value, clocks, tombstones, nodeID, latest} of each entity's replica state."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("path").alias("key"), F.col(c).alias("value"))))))
    # Values are JSON text already, so their object is put together as text.
    values = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col("path").alias("key"), _member_text(F.substring("path", 2, 1 << 30), F.col("value").cast("string")).alias("m")))))
    latest = F.max(F.greatest("write_hlc", "tomb_hlc"))
    rows = state.groupBy(*key).agg(values.alias("value"), entries("write_hlc").alias("clocks"), entries("tomb_hlc").alias("tombstones"), latest.alias("latest"))
    rest = F.to_json(F.struct("clocks", "tombstones", F.lit(node).alias("nodeID"), "latest"))
    return rows.select(*key, F.concat(F.lit('{"value":{'), F.array_join("value.m", ","), F.lit("},"), F.substring(rest, 2, 1 << 30)).alias("snapshot"))


def json_to_state(texts: DataFrame, key: list[str], text: str = "snapshot") -> DataFrame:
    """Replica state rows of snapshot texts."""
    x = F.from_json(F.col(text), f"value map<string,string>, clocks map<string,{STAMP}>, tombstones map<string,{STAMP}>")
    kinds = F.from_json(F.col(text), "value map<string,variant>")["value"]
    wide = texts.select(*key, x.alias("x"), F.transform_values(kinds, lambda _, v: F.schema_of_variant(v) == "STRING").alias("quoted"))
    paths = F.array_union(F.coalesce(F.map_keys("x.clocks"), F.array()), F.coalesce(F.map_keys("x.tombstones"), F.array()))
    rows = wide.select(*key, "x", "quoted", F.explode(paths).alias("path"))
    at = lambda m, k: F.try_element_at(F.col(m), k)
    name = F.substring("path", 2, 1 << 30)
    value = F.when(at("quoted", name), quoted(at("x.value", name))).otherwise(at("x.value", name))
    return rows.select(*key, "path", value.alias("value"), at("x.clocks", F.col("path")).alias("write_hlc"), at("x.tombstones", F.col("path")).alias("tomb_hlc"))
