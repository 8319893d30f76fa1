"""Canonical JSON text, deep equality and clones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import join, normalise
from .schema import IGNORE, tagged

Rule = Callable[[Column, Column], Column]


def has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(has_map(f.dataType) for f in dtype)


def comparable(column: Column, dtype: T.DataType) -> Column:
    """The column with every map as its sorted entries, so that = and ordering apply."""
    if not has_map(dtype):
        return column
    if isinstance(dtype, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], dtype.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(column), entry))
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: comparable(x, dtype.elementType))
    return F.when(column.isNotNull(), F.struct(*[comparable(column.getField(f.name), f.dataType).alias(f.name) for f in dtype]))


def canonical(column: Column, dtype: T.DataType) -> Column:
    """JSON text of a value; null for null. Map entries are sorted by key; null fields are written."""
    text = F.to_json(F.struct(sorted_maps(column, dtype).alias("v")), {"ignoreNullFields": "false"})
    return F.when(column.isNotNull(), F.substring(text, F.lit(6), F.length(text) - 6))


def sorted_maps(column: Column, dtype: T.DataType) -> Column:
    if not has_map(dtype):
        return column
    if isinstance(dtype, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(column)) if not has_map(dtype.valueType) else F.transform(F.array_sort(F.map_entries(column), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: F.struct(e["key"].alias("key"), sorted_maps(e["value"], dtype.valueType).alias("value"))))
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: sorted_maps(x, dtype.elementType))
    return F.when(column.isNotNull(), F.struct(*[sorted_maps(column.getField(f.name), f.dataType).alias(f.name) for f in dtype]))


def deep_equal(a: Column, b: Column, dtype: T.DataType, ignore: set[str] = frozenset(), rules: dict[str, Rule] | None = None, ieee_nan: bool = False, path: tuple[str, ...] = ()) -> Column:
    """Null-safe equality. ignore: paths left out; rules: {path or type name: (a, b) -> boolean Column}; ieee_nan: NaN differs from itself."""
    rule = (rules or {}).get(join(path)) or (rules or {}).get(dtype.simpleString())
    if rule:
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(rule(a, b))
    below = path and any(p.startswith(join(path)) for p in (*ignore, *(rules or {}))) or not path
    if isinstance(dtype, T.StructType) and (below or ieee_nan or any(tagged(f, IGNORE) for f in dtype)):
        parts = [deep_equal(a.getField(f.name), b.getField(f.name), f.dataType, ignore, rules, ieee_nan, (*path, f.name)) for f in dtype if not tagged(f, IGNORE) and normalise(join((*path, f.name))) not in ignore]
        both = F.lit(True)
        for p in parts:
            both = both & p
        return (a.isNull() == b.isNull()) & both
    same = comparable(a, dtype).eqNullSafe(comparable(b, dtype))
    if ieee_nan and isinstance(dtype, (T.FloatType, T.DoubleType)):
        return same & ~F.coalesce(F.isnan(a), F.lit(False))
    return same


def row_equal(a: DataFrame, b: DataFrame, key: list[str], ignore: set[str] = frozenset(), rules: dict[str, Rule] | None = None) -> DataFrame:
    """key, equal (1 or 0) for every entity on either side; one full outer join."""
    left, right = a.select(*key, F.struct(*[c for c in a.columns if c not in key]).alias("_a")), b.select(*key, F.struct(*[c for c in b.columns if c not in key]).alias("_b"))
    both = left.join(right, key, "full_outer")
    return both.select(*key, deep_equal(F.col("_a"), F.col("_b"), both.schema["_a"].dataType, {normalise(p) for p in ignore}, rules).cast("int").alias("equal"))


def table_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def clone(df: DataFrame, ignore: set[str] = frozenset(), rewrite: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The same rows: ignored paths and fields become null, rewritten paths pass through their function."""
    gone, done = {normalise(p) for p in ignore}, {normalise(p): f for p, f in (rewrite or {}).items()}

    def copy(column: Column, dtype: T.DataType, names: tuple[str, ...], dropped: bool) -> Column:
        path = normalise(join(names))
        if dropped or path in gone:
            return F.lit(None).cast(dtype)
        if path in done:
            return done[path](column)
        if isinstance(dtype, T.StructType) and (any(p.startswith(path + "/") for p in (*gone, *done)) or any(tagged(f, IGNORE) for f in dtype)):
            return F.when(column.isNotNull(), F.struct(*[copy(column.getField(f.name), f.dataType, (*names, f.name), tagged(f, IGNORE)).alias(f.name) for f in dtype]))
        return column

    return df.select(*[copy(F.col(f"`{f.name}`"), f.dataType, (f.name,), tagged(f, IGNORE)).alias(f.name) for f in df.schema])


def canonical_keys(column: Column, rule: Callable[[Column], Column]) -> Column:
    """A map with its keys rewritten, for keys that mean the same in several spellings; of equal ones the last stays."""
    entries = F.transform(F.map_entries(column), lambda e: F.struct(rule(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def hash_key(column: Column, dtype: T.DataType) -> Column:
    """A prefilter for equal values; lists and maps have none."""
    return F.lit(None).cast("long") if isinstance(dtype, (T.ArrayType, T.MapType)) else F.xxhash64(canonical(column, dtype))
