"""Differences between two snapshots as op rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import canonical, comparable, deep_equal
from ..functions.paths import escape, escape_column, join, normalise
from ..functions.schema import ATOMIC, IGNORE, checked, element_key, tagged
from .text import is_text

OP = "struct<kind:string,path:string,from_path:string,old:string,new:string>"
Custom = Callable[[Column, Column, Column], Column]


def _op(kind: Column | str, path: Column, old: Column, new: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), path.alias("path"), none.alias("from_path"), old.cast("string").alias("old"), new.cast("string").alias("new"))


def _nothing() -> Column:
    return F.array().cast(f"array<{OP}>")


def kind_of(a: Column, b: Column) -> Column:
    """add from null, remove to null, else replace."""
    return F.when(a.isNull(), "add").when(b.isNull(), "remove").otherwise("replace")


def _whole(a: Column, b: Column, dtype: T.DataType, path: Column, ieee_nan: bool = False, rules: dict | None = None) -> Column:
    """One op if the values differ."""
    same = deep_equal(a, b, dtype, rules=rules, ieee_nan=ieee_nan)
    return F.when(same, _nothing()).otherwise(F.array(_op(kind_of(a, b), path, canonical(a, dtype), canonical(b, dtype))))


def _below(path: Column, token: Column) -> Column:
    return F.concat(path, F.lit("/"), escape_column(token.cast("string")))


def value_ops(
    a: Column, b: Column, dtype: T.DataType, path: Column, custom: dict[str, Custom] | None = None, ieee_nan: bool = False, preserve_order: bool = False, atomic: bool = False, names: tuple[str, ...] | None = None
) -> Column:
    """The array of ops that turn a into b.

    Scalars, atomic fields and values on one side: one op. Structs: by field. Maps: by key, ascending;
    a null map counts as empty when it is populated. Keyed lists: by key, ascending; order is ignored
    unless preserve_order. Other lists: one replace if lengths differ, else by position. names: the path, where it is the same in all rows.
    """
    if custom and (rule := (custom.get(normalise(join(names))) if names else None) or custom.get(dtype.simpleString())):
        return getattr(rule, "diff", rule)(a, b, path)
    if atomic:
        return _whole(a, b, dtype, path, ieee_nan)
    go = lambda x, y, kind, p: value_ops(x, y, kind, p, custom, ieee_nan, preserve_order)
    if isinstance(dtype, T.StructType):
        parts = [
            value_ops(a.getField(f.name), b.getField(f.name), f.dataType, F.concat(path, F.lit(f"/{escape(f.name)}")), custom, ieee_nan, preserve_order, tagged(f, ATOMIC), names and (*names, f.name))
            for f in dtype if not tagged(f, IGNORE)
        ]
        return F.when(a.isNull() | b.isNull(), _whole(a, b, dtype, path)).otherwise(F.concat(*parts) if parts else _nothing())
    if isinstance(dtype, T.MapType):
        x, y = F.coalesce(a, F.create_map().cast(dtype)), b
        keys = F.array_sort(F.array_union(F.map_keys(x), F.map_keys(y)))

        def one(k: Column) -> Column:
            here, had, has = _below(path, k), F.map_contains_key(x, k), F.map_contains_key(y, k)
            old, new = F.try_element_at(x, k), F.try_element_at(y, k)
            added, removed = F.array(_op("add", here, F.lit(None), F.coalesce(canonical(new, dtype.valueType), F.lit("null")))), F.array(_op("remove", here, F.coalesce(canonical(old, dtype.valueType), F.lit("null")), F.lit(None)))
            return F.when(~had, added).when(~has, removed).otherwise(go(old, new, dtype.valueType, here))

        return F.when(a.isNull() & b.isNull(), _nothing()).when(b.isNull(), _whole(a, b, dtype, path)).when(a.isNull() & (F.size(b) == 0), _whole(a, b, dtype, path)).otherwise(F.flatten(F.transform(keys, one)))
    if is_text(dtype):  # runs are one value: they change as a whole and merge when applied
        return _whole(a, b, dtype, path)
    if isinstance(dtype, T.ArrayType) and (name := element_key(dtype)):
        key = lambda x: x.getField(name)
        keys = F.array_sort(F.array_union(F.transform(a, key), F.transform(b, key)))

        def element(k: Column) -> Column:
            here = _below(path, k)
            last = lambda xs: F.try_element_at(F.filter(xs, lambda x: key(x).eqNullSafe(k)), F.lit(-1))
            old, new, kind = last(a), last(b), dtype.elementType
            return F.when(old.isNull(), F.array(_op("add", here, F.lit(None), canonical(new, kind)))).when(new.isNull(), F.array(_op("remove", here, canonical(old, kind), F.lit(None)))).otherwise(go(old, new, kind, here))

        ops = F.flatten(F.transform(keys, element))
        if preserve_order:
            moved = ~F.transform(F.filter(a, lambda x: F.array_contains(F.transform(b, key), key(x))), key).eqNullSafe(F.transform(F.filter(b, lambda x: F.array_contains(F.transform(a, key), key(x))), key))
            ops = F.concat(ops, F.when(moved, F.array(_op("replace", path, canonical(a, dtype), canonical(b, dtype)))).otherwise(_nothing()))
        return F.when(a.isNull() | b.isNull(), _whole(a, b, dtype, path)).otherwise(ops)
    if isinstance(dtype, T.ArrayType):
        kind = dtype.elementType
        each = F.flatten(F.transform(a, lambda x, i: go(x, F.get(b, i), kind, _below(path, i))))
        return F.when(a.isNull() | b.isNull(), _whole(a, b, dtype, path)).when(comparable(a, dtype).eqNullSafe(comparable(b, dtype)), _nothing()).when(F.size(a) != F.size(b), F.array(_op("replace", path, canonical(a, dtype), canonical(b, dtype)))).otherwise(each)
    return _whole(a, b, dtype, path, ieee_nan)


def _pruned(column: Column, dtype: T.DataType, names: tuple[str, ...], ignored: set[str]) -> tuple[Column, T.DataType]:
    """A field without what is ignored below it."""
    if not isinstance(dtype, T.StructType):
        return column, dtype
    inner = {f.name: _pruned(column.getField(f.name), f.dataType, (*names, f.name), ignored) for f in dtype if not tagged(f, IGNORE) and normalise(join((*names, f.name))) not in ignored}
    fields = [T.StructField(f.name, inner[f.name][1], f.nullable, f.metadata) for f in dtype if f.name in inner]
    if fields == dtype.fields:
        return column, dtype
    return F.when(column.isNotNull(), F.struct(*[c.alias(n) for n, (c, _) in inner.items()])), T.StructType(fields)


def diff(
    a: DataFrame, b: DataFrame, key: list[str], ignore: Iterable[str] = (), custom: dict[str, Custom] | None = None, rows: str = "whole",
    ieee_nan: bool = False, preserve_order: bool = False, schema: T.StructType | None = None,
) -> DataFrame:
    """Op rows (key, seq, kind, path, from_path, old, new) that turn snapshot a into snapshot b.

    One full outer join on the entity key, whose columns must not be null; both scans read only the
    compared columns. Ops of an entity follow the fields' declaration. rows: an entity on one side
    only is one op at / (whole), or an op for each non-null field (leaves). schema: a's with field metadata.
    custom: {path or type: (old, new, path) -> array of op structs, or an object whose method diff is that}. NaN equals NaN unless ieee_nan.
    """
    schema = schema or a.schema
    checked(schema)
    ignored = {normalise(p) for p in ignore}
    tops = [f for f in schema if f.name not in key and not tagged(f, IGNORE) and normalise(join([f.name])) not in ignored]
    if not tops:
        raise ValueError("no field is left to compare")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*[_pruned(F.col(f"`{f.name}`"), f.dataType, (f.name,), ignored)[0].alias(f.name) for f in tops]).alias(name))

    both = side(a, "_a").join(side(b, "_b"), key, "full_outer")
    kinds = [(f, _pruned(F.lit(None), f.dataType, (f.name,), ignored)[1]) for f in tops]
    rules = {normalise(k) if k.startswith("/") else k: v for k, v in (custom or {}).items()}
    old, new = (lambda f: F.col("_a").getField(f.name)), (lambda f: F.col("_b").getField(f.name))
    parts = [value_ops(old(f), new(f), kind, F.lit(join([f.name])), rules, ieee_nan, preserve_order, tagged(f, ATOMIC), (f.name,)) for f, kind in kinds]
    ops = F.concat(*parts) if len(parts) > 1 else parts[0]
    kind = T.StructType([T.StructField(f.name, k) for f, k in kinds])
    if rows == "whole":
        gone, come = F.array(_op("remove", F.lit("/"), canonical(F.col("_a"), kind), F.lit(None))), F.array(_op("add", F.lit("/"), F.lit(None), canonical(F.col("_b"), kind)))
        ops = F.when(F.col("_b").isNull(), gone).when(F.col("_a").isNull(), come).otherwise(ops)
    else:
        one_sided = [_whole(old(f), new(f), k, F.lit(join([f.name]))) for f, k in kinds]
        ops = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.concat(*one_sided)).otherwise(ops)
    return both.select(*key, F.posexplode(ops).alias("seq", "op")).select(*key, "seq", "op.*")


def diff_keyed_list(a: DataFrame, b: DataFrame, key: list[str], column: str, element: str) -> DataFrame:
    """The same for one keyed list by rows: both sides are exploded and joined on entity and element key, so lists of any length are
    spread over tasks. Returns key, element key text, kind, path, field, old, new; the last of equal element keys counts."""
    kind = a.schema[column].dataType.elementType

    def side(df: DataFrame, name: str) -> DataFrame:
        flat = df.select(*key, F.posexplode(column).alias("_i", "_x"))
        return flat.groupBy(*key, F.col(f"_x.`{element}`").alias("_k")).agg(F.max_by("_x", "_i").alias(name))

    both = side(a, "_a").join(side(b, "_b"), [*key, "_k"], "full_outer")
    here = _below(F.lit(f"/{column}"), F.col("_k"))
    ops = F.when(F.col("_a").isNull(), F.array(_op("add", here, F.lit(None), canonical(F.col("_b"), kind)))).when(F.col("_b").isNull(), F.array(_op("remove", here, canonical(F.col("_a"), kind), F.lit(None)))).otherwise(value_ops(F.col("_a"), F.col("_b"), kind, here))
    return both.select(*key, F.col("_k").alias("element"), F.explode(ops).alias("op")).select(*key, "element", "op.*")


def membership_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, kind for keys on one side only; two anti joins."""
    mine, theirs = a.select(*key).distinct(), b.select(*key).distinct()
    return theirs.join(mine, key, "left_anti").withColumn("kind", F.lit("add")).unionByName(mine.join(theirs, key, "left_anti").withColumn("kind", F.lit("remove")))
