"""JSON Pointer paths, and reading, setting and deleting at a path as Column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@cache
def parse(pointer: str) -> tuple[str, ...]:
    """Tokens of a pointer; "" and "/" are the root, a missing first slash is allowed."""
    if pointer in ("", "/"):
        return ()
    return tuple(t.replace("~1", "/").replace("~0", "~") for t in pointer.removeprefix("/").split("/"))


def escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def join(tokens) -> str:
    return "".join(f"/{escape(str(t))}" for t in tokens) or "/"


def normalise(pointer: str) -> str:
    """Index tokens without leading zeros, one leading slash."""
    return join(str(int(t)) if t.isascii() and t.isdigit() else t for t in parse(pointer))


def parse_column(pointer: Column) -> Column:
    """The tokens of a column of pointers."""
    rest = F.when(pointer.startswith("/"), F.substring(pointer, 2, 1 << 30)).otherwise(pointer)
    tokens = F.transform(F.split(rest, "/"), lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(pointer.isin("", "/"), F.array().cast("array<string>")).otherwise(tokens)


def escape_column(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def field(schema: T.StructType, selector: str) -> str:
    """Pointer of a dotted column name, checked against the schema."""
    here: T.DataType = schema
    names = selector.split(".")
    for name in names:
        if not isinstance(here, T.StructType) or name not in here.names:
            raise KeyError(f"{selector}: there is no field {name}")
        here = here[name].dataType
    return join(names)


def resolve_parent(pointer: str) -> tuple[str, str]:
    """(the path above, the last token); the root has no parent."""
    tokens = parse(pointer)
    if not tokens:
        raise PathError("/: the root has no parent")
    return join(tokens[:-1]), tokens[-1]


def at(pointer: str, index: int) -> str:
    return join((*parse(pointer), index))


def map_key(pointer: str, key) -> str:
    return join((*parse(pointer), key))


def literal(value, dtype: T.DataType) -> Column:
    """A Python value as the given type; numbers are converted, nested values go through JSON."""
    if isinstance(value, Column):
        return value.cast(dtype)
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(F.lit(json.dumps(value)), dtype)
    if isinstance(dtype, T.StringType):
        return F.lit(value if isinstance(value, str) else json.dumps(value))
    return F.lit(value).try_cast(dtype)


def key_literal(token: str, dtype: T.DataType) -> Column:
    """A path token as a map key."""
    return F.lit(token) if isinstance(dtype, T.StringType) else F.lit(token).try_cast(dtype)


def key_text(column: Column) -> Column:
    return column.cast("string")


@dataclass
class Found:
    """value at a path (null if absent), its type, and whether the path leads to a place: true, or false for an absent map key
    or element, or null where a null value stands in the way."""

    value: Column
    dtype: T.DataType
    present: Column
    in_map: bool = False


class PathError(ValueError):
    """A path that no row of the schema can have."""


def _key_of(dtype: T.DataType) -> str | None:
    from .schema import element_key

    return element_key(dtype)


def _index(token: str, path: str) -> int:
    if not (token.isascii() and token.isdigit()):
        raise PathError(f"{path}: {token} isn't an index")
    return int(token)


def resolve(column: Column, dtype: T.DataType, tokens: tuple[str, ...]) -> Found:
    out = Found(column, dtype, F.lit(True))
    for i, t in enumerate(tokens):
        path, here, parent = join(tokens[: i + 1]), out.dtype, out.value
        if isinstance(here, T.StructType):
            if t not in here.names:
                raise PathError(f"{path}: no such field")
            out = Found(parent.getField(t), here[t].dataType, F.when(parent.isNull(), F.lit(None)).otherwise(out.present))
        elif isinstance(here, T.MapType):
            k = key_literal(t, here.keyType)
            out = Found(F.try_element_at(parent, k), here.valueType, F.coalesce(F.map_contains_key(parent, k), F.lit(False)), True)
        elif isinstance(here, T.ArrayType) and (name := _key_of(here)):
            same = F.filter(parent, _is(name, t))
            out = Found(F.get(same, 0), here.elementType, F.size(same) > 0)
        elif isinstance(here, T.ArrayType):
            k = _index(t, path)
            out = Found(F.get(parent, k), here.elementType, F.size(parent) > k)
        else:
            raise PathError(f"{path}: {here.simpleString()} has no parts")
    return out



def _is(name: str, token: str):
    return lambda x: key_text(x.getField(name)) == token


def _none() -> Column:
    return F.lit(None).cast("string")


def set_at(column: Column, dtype: T.DataType, tokens: tuple[str, ...], value: Column, path: str = "") -> tuple[Column, Column]:
    """(new column, error text or null). Map keys and keyed elements are added or replaced; an index may be the list's length, which appends."""
    if not tokens:
        return value, _none()
    t, rest = tokens[0], tokens[1:]
    here = f"{path}/{escape(t)}"
    if isinstance(dtype, T.StructType):
        if t not in dtype.names:
            raise PathError(f"{here}: no such field")
        child, error = set_at(column.getField(t), dtype[t].dataType, rest, value, here)
        return F.when(column.isNotNull(), column.withField(f"`{t}`", child)), F.when(column.isNull(), F.lit(f"{path or '/'}: null has no field")).otherwise(error)
    if isinstance(dtype, T.MapType):
        k = key_literal(t, dtype.keyType)
        old = F.try_element_at(column, k)
        child, error = set_at(old, dtype.valueType, rest, value, here)
        others = F.coalesce(F.map_filter(column, lambda x, _: x != k), F.create_map().cast(dtype))
        if rest:
            error = F.when(~F.coalesce(F.map_contains_key(column, k), F.lit(False)), F.lit(f"{here}: no such key")).otherwise(error)
        error = F.when(k.isNull(), F.lit(f"{here}: no key of type {dtype.keyType.simpleString()}")).otherwise(error)
        return F.when(error.isNull(), F.map_concat(others, F.create_map(F.coalesce(k, _any_key(dtype.keyType)), child))).otherwise(column), error
    if isinstance(dtype, T.ArrayType) and (name := _key_of(dtype)):
        own = lambda x: key_text(x.getField(name)).eqNullSafe(F.lit(t))
        present = F.coalesce(F.exists(column, own), F.lit(False))
        if rest:
            _, error = set_at(F.get(F.filter(column, own), 0), dtype.elementType, rest, value, here)
            new = F.transform(column, lambda x: F.when(own(x), set_at(x, dtype.elementType, rest, value, here)[0]).otherwise(x))
            return new, F.when(~present, F.lit(f"{here}: no such element")).otherwise(error)
        changed = F.transform(column, lambda x: F.when(own(x), value).otherwise(x))
        return F.when(present, changed).otherwise(F.array_append(F.coalesce(column, F.array().cast(dtype)), value)), _none()
    if isinstance(dtype, T.ArrayType):
        k = _index(t, here)
        n = F.coalesce(F.size(column), F.lit(0))
        inside = lambda: F.transform(column, lambda x, i: F.when(i == k, set_at(x, dtype.elementType, rest, value, here)[0]).otherwise(x))
        _, error = set_at(F.get(column, k), dtype.elementType, rest, value, here)
        if rest:
            return F.when(n > k, inside()).otherwise(column), F.when(n <= k, F.lit(f"{here}: out of range")).otherwise(error)
        grown = F.array_append(F.coalesce(column, F.array().cast(dtype)), value)
        return F.when(n > k, inside()).when(n == k, grown).otherwise(column), F.when(n < k, F.lit(f"{here}: out of range"))
    raise PathError(f"{here}: {dtype.simpleString()} has no parts")


def _any_key(dtype: T.DataType) -> Column:
    """Stands in for a null key in a branch that is not taken."""
    return F.lit("0").cast(dtype)


def insert_keyed(column: Column, dtype: T.DataType, element: Column, previous: Column | None = None) -> Column:
    """A keyed list with an element that it lacks: after the one of key text `previous` (else at the start), and then past
    all that follow with a smaller key text, so that replicas place concurrent insertions alike."""
    name = _key_of(dtype)
    if name is None:
        raise PathError(f"{dtype.simpleString()} has no element key")
    xs, own = F.coalesce(column, F.array().cast(dtype)), key_text(element.getField(name))
    keys = F.transform(xs, lambda x: key_text(x.getField(name)))
    start = F.array_position(keys, previous).cast("int") if previous is not None else F.lit(0)
    start = F.coalesce(start, F.lit(0))
    rest = F.slice(keys, start + 1, F.greatest(F.size(keys) - start, F.lit(0)))
    stop = F.array_position(F.transform(rest, lambda k: k >= own), F.lit(True)).cast("int")
    place = start + F.when(stop == 0, F.size(rest)).otherwise(stop - 1)
    return F.concat(F.slice(xs, F.lit(1), place), F.array(element), F.slice(xs, place + 1, F.greatest(F.size(xs) - place, F.lit(0))))


def delete_at(column: Column, dtype: T.DataType, tokens: tuple[str, ...], path: str = "", zero: bool = False) -> tuple[Column, Column]:
    """(new column, error text or null). A struct field becomes null (or its type's zero), a map key goes, a list element goes and the rest moves up."""
    if not tokens:
        return column, F.lit("/: the root can't be removed")
    t, rest = tokens[0], tokens[1:]
    here = f"{path}/{escape(t)}"
    if isinstance(dtype, T.StructType):
        if t not in dtype.names:
            raise PathError(f"{here}: no such field")
        kind = dtype[t].dataType
        child, error = (zero_of(kind) if zero else F.lit(None).cast(kind), _none()) if not rest else delete_at(column.getField(t), kind, rest, here, zero)
        return F.when(column.isNotNull(), column.withField(f"`{t}`", child)), F.when(column.isNull(), F.lit(f"{path or '/'}: null has no field")).otherwise(error)
    if isinstance(dtype, T.MapType):
        k = key_literal(t, dtype.keyType)
        if not rest:
            return F.map_filter(column, lambda x, _: F.coalesce(x != k, F.lit(True))), F.when(k.isNull(), F.lit(f"{here}: no key of type {dtype.keyType.simpleString()}"))
        present = F.coalesce(F.map_contains_key(column, k), F.lit(False))
        _, error = delete_at(F.try_element_at(column, k), dtype.valueType, rest, here, zero)
        new = F.transform_values(column, lambda x, v: F.when(x == k, delete_at(v, dtype.valueType, rest, here, zero)[0]).otherwise(v))
        return new, F.when(~present, F.lit(f"{here}: no such key")).otherwise(error)
    if isinstance(dtype, T.ArrayType):
        name = _key_of(dtype)
        k = None if name else _index(t, here)
        own = (lambda x, i: key_text(x.getField(name)).eqNullSafe(F.lit(t))) if name else (lambda x, i: i == k)
        present = F.coalesce(F.exists(column, lambda x: own(x, None)), F.lit(False)) if name else F.coalesce(F.size(column), F.lit(0)) > k
        missing = F.lit(f"{here}: no such element" if name else f"{here}: out of range")
        if not rest:
            return F.filter(column, lambda x, i: ~own(x, i)), F.when(~present, missing)
        element = F.get(F.filter(column, lambda x, i: own(x, i)), 0)
        _, error = delete_at(element, dtype.elementType, rest, here, zero)
        return F.transform(column, lambda x, i: F.when(own(x, i), delete_at(x, dtype.elementType, rest, here, zero)[0]).otherwise(x)), F.when(~present, missing).otherwise(error)
    raise PathError(f"{here}: {dtype.simpleString()} has no parts")


def zero_of(dtype: T.DataType) -> Column:
    """The typed zero: 0, false, empty text, list or map; null for anything else."""
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    if isinstance(dtype, T.MapType):
        return F.create_map().cast(dtype)
    if isinstance(dtype, T.StructType):
        return F.struct(*[zero_of(f.dataType).alias(f.name) for f in dtype])
    return F.lit(None).cast(dtype)
