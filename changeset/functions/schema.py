"""Field metadata and the walk from a schema to its leaves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import types as T

from .paths import join, normalise

#: Keys of StructField.metadata: the field is left out; apply rejects it; it is compared as one value; it names list elements.
IGNORE, READONLY, ATOMIC, KEY = "ignore", "readonly", "atomic", "key"

_SCALARS = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.NullType)


@dataclass(frozen=True)
class Leaf:
    """A field at which comparison stops going down by struct fields."""

    names: tuple[str, ...]
    dtype: T.DataType
    atomic: bool = False
    readonly: bool = False

    @property
    def path(self) -> str:
        return join(self.names)


def tagged(field: T.StructField, tag: str) -> bool:
    return bool((field.metadata or {}).get(tag))


def with_tags(schema: T.StructType, tags: dict[str, Iterable[str]]) -> T.StructType:
    """The schema with tags added to top-level fields: {"score": ["readonly"]}."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), **{t: True for t in tags.get(f.name, ())}}) for f in schema])


def element_key(dtype: T.DataType) -> str | None:
    """The field that names the elements of a keyed list; the last one tagged."""
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return next((f.name for f in reversed(dtype.elementType.fields) if tagged(f, KEY)), None)
    return None


def checked(dtype: T.DataType, path: str = "") -> None:
    """Refuses kinds that can't be compared or carried."""
    if isinstance(dtype, T.StructType):
        for f in dtype:
            checked(f.dataType, f"{path}/{f.name}")
    elif isinstance(dtype, T.ArrayType):
        checked(dtype.elementType, f"{path}/*")
    elif isinstance(dtype, T.MapType):
        checked(dtype.keyType, f"{path}/*")
        checked(dtype.valueType, f"{path}/*")
    elif not isinstance(dtype, _SCALARS):
        raise TypeError(f"{path or '/'}: {dtype.simpleString()} isn't supported")


def supported(schema: T.StructType) -> list[str]:
    """Names of the columns that can be compared; the rest is skipped."""
    out = []
    for f in schema:
        try:
            checked(f.dataType)
            out.append(f.name)
        except TypeError:
            pass
    return out


def leaves(schema: T.StructType, skip: Iterable[str] = (), ignore: Iterable[str] = ()) -> Iterator[Leaf]:
    """Leaves in order of declaration. skip: columns left out; ignore: paths left out with all below them."""
    ignored = {normalise(p) for p in ignore}

    def walk(fields: T.StructType, names: tuple[str, ...], readonly: bool) -> Iterator[Leaf]:
        for f in fields:
            own = (*names, f.name)
            if tagged(f, IGNORE) or normalise(join(own)) in ignored or not names and f.name in skip:
                continue
            ro = readonly or tagged(f, READONLY)
            if isinstance(f.dataType, T.StructType) and not tagged(f, ATOMIC):
                yield from walk(f.dataType, own, ro)
            else:
                yield Leaf(own, f.dataType, tagged(f, ATOMIC), ro)

    yield from walk(schema, (), False)
