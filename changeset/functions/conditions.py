"""The condition language: a small predicate tree, its wire form, and its Column.

A condition's Column is true, false, or null for "can't be told" (an error): a gate that
asks for true skips such rows, a guard rejects them with a message of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canon import comparable
from .paths import Found, PathError, literal

COMPARE = ("==", "!=", ">", ">=", "<", "<=")
#: Names of the operators in the wire form.
WIRE = {"==": "test", ">": "more", ">=": "more-or-equal", "<": "less", "<=": "less-or-equal", "exists": "defined", "in": "contains", "matches": "matches", "type": "type", "and": "and", "or": "or", "not": "not"}
_BACK = {v: k for k, v in WIRE.items()}
TYPES = ("string", "number", "boolean", "object", "array", "null")
#: Java accepts these; the language doesn't: look-around, atomic groups, back-references, possessive quantifiers.
_FOREIGN = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+")


@dataclass(frozen=True)
class Condition:
    op: str
    path: str = ""
    value: object = None
    sub: tuple[Condition, ...] = ()

    def __post_init__(self) -> None:
        if self.op not in (*COMPARE, "exists", "in", "matches", "type", "and", "or", "not"):
            raise ValueError(f"unknown operator {self.op}")
        if self.op == "not" and len(self.sub) != 1:
            raise ValueError("not takes one condition")
        if self.op == "in" and not isinstance(self.value, (list, tuple)):
            raise ValueError("in takes a list")
        if self.op == "type" and self.value not in TYPES:
            raise ValueError(f"type is one of {TYPES}")
        if self.op == "matches":
            if _FOREIGN.search(str(self.value)):
                raise ValueError(f"not a regular expression of the language: {self.value}")

    def to_predicate(self) -> dict:
        if self.op == "!=":
            return {"op": "not", "apply": [{"op": "test", "path": self.path, "value": self.value}]}
        out: dict = {"op": WIRE[self.op]}
        if self.sub:
            return out | {"apply": [s.to_predicate() for s in self.sub]}
        out["path"] = self.path
        return out if self.op == "exists" else out | {"value": list(self.value) if self.op == "in" else self.value}

    def to_json(self) -> str:
        return json.dumps(self.to_predicate(), separators=(",", ":"))


def from_predicate(wire: dict | str) -> Condition:
    if isinstance(wire, str):
        wire = json.loads(wire)
    if (op := _BACK.get(wire.get("op"))) is None:
        raise ValueError(f"unknown predicate {wire.get('op')}")
    sub = wire.get("apply") or []
    if op == "not" and len(sub) == 1 and sub[0].get("op") == "test":
        return ne(sub[0].get("path", ""), sub[0].get("value"))
    return Condition(op, wire.get("path", ""), wire.get("value"), tuple(map(from_predicate, sub)))


def eq(path: str, value) -> Condition:
    return Condition("==", path, value)


def ne(path: str, value) -> Condition:
    return Condition("!=", path, value)


def gt(path: str, value) -> Condition:
    return Condition(">", path, value)


def ge(path: str, value) -> Condition:
    return Condition(">=", path, value)


def lt(path: str, value) -> Condition:
    return Condition("<", path, value)


def le(path: str, value) -> Condition:
    return Condition("<=", path, value)


def exists(path: str) -> Condition:
    return Condition("exists", path)


def in_(path: str, values) -> Condition:
    return Condition("in", path, list(values))


def matches(path: str, pattern: str) -> Condition:
    return Condition("matches", path, pattern)


def type_is(path: str, name: str) -> Condition:
    return Condition("type", path, name)


def and_(*sub: Condition) -> Condition:
    return Condition("and", sub=sub)


def or_(*sub: Condition) -> Condition:
    return Condition("or", sub=sub)


def not_(sub: Condition) -> Condition:
    return Condition("not", sub=(sub,))





def _error() -> Column:
    return F.lit(None).cast("boolean")


def type_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    return "null" if isinstance(dtype, T.NullType) else "string"


def _constant(value, dtype: T.DataType) -> Column:
    """The constant in the wider of its own and the field's type: 5.7 against an int column stays 5.7."""
    if isinstance(dtype, T.NumericType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(value).cast(dtype)
    return literal(value, dtype)


def _fits(value, dtype: T.DataType) -> bool:
    kind = type_name(dtype)
    own = "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "array" if isinstance(value, list) else "object" if isinstance(value, dict) else "string"
    return kind == own


def compile_condition(cond: Condition, resolve: Callable[[str], Found], ignore_case: bool = False) -> Column:
    """The condition over the state that resolve reads; a path that the schema lacks is an error (null), absent for exists."""
    if cond.op == "and":
        out = F.lit(True)
        for s in reversed(cond.sub):
            c = compile_condition(s, resolve, ignore_case)
            out = F.when(c.isNull(), _error()).when(~c, F.lit(False)).otherwise(out)
        return out
    if cond.op == "or":
        out = F.lit(False)
        for s in cond.sub:
            out = out | F.coalesce(compile_condition(s, resolve, ignore_case), F.lit(False))
        return out
    if cond.op == "not":
        return ~compile_condition(cond.sub[0], resolve, ignore_case)
    try:
        found = resolve(cond.path)
    except PathError:
        return F.lit(False) if cond.op == "exists" else _error()
    value, dtype = found.value, found.dtype
    present = F.coalesce(found.present, F.lit(False))
    if cond.op == "exists":
        return present if found.in_map else present & value.isNotNull()
    if cond.op == "type":
        return F.when(value.isNull(), F.lit(cond.value == "null")).otherwise(F.lit(cond.value == type_name(dtype)))
    if cond.op == "matches":
        return value.cast("string").rlike(cond.value)
    if cond.op == "in":
        usable = [v for v in cond.value if _fits(v, dtype)]
        one = F.lit(False)
        for v in usable:
            one = one | (comparable(value, dtype) == comparable(_constant(v, dtype), dtype))
        return F.when(value.isNotNull(), one)
    if cond.value is None:  # a test for null can always be told
        null = value.isNull()
        return null if cond.op == "==" else ~null if cond.op == "!=" else _error()
    if not _fits(cond.value, dtype):
        same = F.when(value.isNotNull(), F.lit(False))
        test = same if cond.op == "==" else ~same if cond.op == "!=" else _error()
    elif cond.op in ("==", "!="):
        x, y = comparable(value, dtype), comparable(_constant(cond.value, dtype), dtype)
        if ignore_case and isinstance(dtype, T.StringType):
            x, y = F.lower(x), F.lower(y)
        test = x == y if cond.op == "==" else x != y
    elif type_name(dtype) not in ("string", "number"):
        test = _error()
    else:
        y = _constant(cond.value, dtype)
        test = {">": value > y, ">=": value >= y, "<": value < y, "<=": value <= y}[cond.op]
    return F.when(present, test).otherwise(F.lit(cond.op == "!=")) if found.in_map else test


def gate(if_: Column | None, unless: Column | None) -> Column:
    """Whether an operation goes ahead: if is true, and unless is cleanly false."""
    out = F.lit(True)
    if if_ is not None:
        out = out & F.coalesce(if_, F.lit(False))
    if unless is not None:
        out = out & ~F.coalesce(unless, F.lit(True))
    return out


def guard_status(guard: Column | None) -> Column:
    """null, guard_error or guard_failed."""
    if guard is None:
        return F.lit(None).cast("string")
    return F.when(guard.isNull(), "guard_error").when(~guard, "guard_failed")
