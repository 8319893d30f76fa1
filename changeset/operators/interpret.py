"""An interpreter of operations on one row, for patch tables with conditions and nested paths."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.conditions import Condition, from_predicate, type_name
from ..functions.paths import parse
from ..functions.schema import IGNORE, READONLY, element_key, tagged
from .text import from_runs, is_text, merge, to_runs


class Failed(Exception):
    pass


_ABSENT = object()


def _converted(value, dtype: T.DataType, path: str):
    if value is None:
        return None
    try:
        if isinstance(dtype, T.StructType):
            return {f.name: _converted(value.get(f.name), f.dataType, path) for f in dtype}
        if isinstance(dtype, T.MapType):
            return {_key(str(k), dtype.keyType, path): _converted(v, dtype.valueType, path) for k, v in value.items()}
        if isinstance(dtype, T.ArrayType):
            return [_converted(v, dtype.elementType, path) for v in value]
        if isinstance(dtype, T.IntegralType):
            return int(value)
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return float(value)
        if isinstance(dtype, T.BooleanType):
            return bool(value)
        if isinstance(dtype, T.StringType):
            return value if isinstance(value, str) else json.dumps(value)
    except (ValueError, TypeError, AttributeError):
        raise Failed(f"{path}: no value of type {dtype.simpleString()}") from None
    return value


def _key(token: str, dtype: T.DataType, path: str):
    if isinstance(dtype, T.IntegralType):
        if not re.fullmatch(r"-?\d+", token):
            raise Failed(f"{path}: no key of type {dtype.simpleString()}")
        return int(token)
    return token


def _place(box, dtype: T.DataType, token: str, path: str):
    """(key into the Python value or the position in a list, type of the part); position -1: a keyed element that is absent."""
    if box is None and not isinstance(dtype, (T.MapType, T.ArrayType)):
        raise Failed(f"{path}: null has no parts")
    if isinstance(dtype, T.StructType):
        if token not in dtype.names:
            raise Failed(f"{path}: no such field")
        return token, dtype[token].dataType
    if isinstance(dtype, T.MapType):
        return _key(token, dtype.keyType, path), dtype.valueType
    if isinstance(dtype, T.ArrayType):
        if name := element_key(dtype):
            return next((i for i, x in enumerate(box or []) if str(x[name]) == token), -1), dtype.elementType
        if not (token.isascii() and token.isdigit()):
            raise Failed(f"{path}: {token} isn't an index")
        return int(token), dtype.elementType
    raise Failed(f"{path}: {dtype.simpleString()} has no parts")


def _get(box, dtype: T.DataType, tokens: tuple[str, ...], path: str):
    """(value or _ABSENT, type)."""
    for t in tokens:
        if box is _ABSENT:
            raise Failed(f"{path}: there is no value")
        at, kind = _place(box, dtype, t, path)
        if isinstance(dtype, T.ArrayType):
            box = box[at] if box is not None and 0 <= at < len(box) else _ABSENT
        else:
            box = (box or {}).get(at, _ABSENT)
        dtype = kind
    return box, dtype


def _put(box, dtype: T.DataType, tokens: tuple[str, ...], value, path: str):
    """The value with a part set; boxes along the path are copied, so earlier states stay whole."""
    if not tokens:
        return _converted(value, dtype, path)
    at, kind = _place(box, dtype, tokens[0], path)
    if isinstance(dtype, T.ArrayType):
        out = list(box or [])
        if at == -1 and len(tokens) == 1 or at == len(out):
            if len(tokens) > 1:
                raise Failed(f"{path}: out of range")
            return [*out, _converted(value, kind, path)]
        if not 0 <= at < len(out):
            raise Failed(f"{path}: no such element" if at < 0 else f"{path}: out of range")
        out[at] = _put(out[at], kind, tokens[1:], value, path)
        return out
    out = dict(box or {})
    if len(tokens) > 1 and isinstance(dtype, T.MapType) and at not in out:
        raise Failed(f"{path}: no such key")
    out[at] = _put(out.get(at), kind, tokens[1:], value, path)
    return out


def _drop(box, dtype: T.DataType, tokens: tuple[str, ...], path: str):
    if not tokens:
        raise Failed("/: the root can't be removed")
    at, kind = _place(box, dtype, tokens[0], path)
    if isinstance(dtype, T.ArrayType):
        out = list(box or [])
        if not 0 <= at < len(out):
            raise Failed(f"{path}: no such element" if at < 0 else f"{path}: out of range")
        if len(tokens) == 1:
            del out[at]
        else:
            out[at] = _drop(out[at], kind, tokens[1:], path)
        return out
    out = dict(box or {})
    if len(tokens) > 1:
        if at not in out:
            raise Failed(f"{path}: no such key")
        out[at] = _drop(out[at], kind, tokens[1:], path)
    elif isinstance(dtype, T.MapType):
        out.pop(at, None)
    else:
        out[at] = None
    return out


def evaluate(cond: Condition, row: dict, schema: T.StructType) -> bool | None:
    """True, false, or None for a condition that can't be told."""
    if cond.op == "and":
        for s in cond.sub:
            if (r := evaluate(s, row, schema)) is not True:
                return r
        return True
    if cond.op == "or":
        return any(evaluate(s, row, schema) is True for s in cond.sub)
    if cond.op == "not":
        r = evaluate(cond.sub[0], row, schema)
        return None if r is None else not r
    tokens = parse(cond.path)
    try:
        value, dtype = _get(row, schema, tokens, cond.path)
        in_map = bool(tokens) and isinstance(_get(row, schema, tokens[:-1], cond.path)[1], T.MapType)
    except Failed:
        return False if cond.op == "exists" else None
    if cond.op == "exists":
        return value is not _ABSENT and (in_map or value is not None)
    if value is _ABSENT:
        if in_map and cond.op in ("==", "!=", ">", ">=", "<", "<="):
            return cond.op == "!="
        value = None
    if cond.op == "type":
        return cond.value == ("null" if value is None else type_name(dtype))
    if cond.value is None and cond.op in ("==", "!="):
        return (value is None) == (cond.op == "==")
    if value is None:
        return None
    if cond.op == "matches":
        text = str(value).lower() if isinstance(value, bool) else str(value)
        return re.search(cond.value, text) is not None
    same = lambda v: v == value and isinstance(v, bool) == isinstance(value, bool)
    if cond.op == "in":
        return any(same(v) for v in cond.value)
    if cond.op in ("==", "!="):
        return same(cond.value) == (cond.op == "==")
    if type(cond.value) is bool or type(value) is bool or isinstance(cond.value, str) != isinstance(value, str) or not isinstance(value, (int, float, str)):
        return None
    x, y = (value.encode(), cond.value.encode()) if isinstance(value, str) else (value, cond.value)
    return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[cond.op]


def _merged_text(row: dict, op: dict, schema: T.StructType) -> dict | None:
    """The row with runs merged into a text field, whatever the op's conditions: merging converges, so it needs none. None for other fields."""
    tokens = parse(op["path"])
    try:
        have, dtype = _get(row, schema, tokens, op["path"])
        if not is_text(dtype):
            return None
        runs = merge(to_runs(None if have is _ABSENT else have), to_runs(json.loads(op["new"])))
        return _put(row, schema, tokens, from_runs(runs), op["path"])
    except Failed:
        return None


def apply_ops(row: dict, ops: list[dict], schema: T.StructType, fixed: set[str]) -> tuple[dict, list[str], list[str]]:
    """The row after its operations, errors and log lines. fixed: key columns, which can't be written."""
    errors, lines = [], []
    for op in ops:
        if op["kind"] in ("add", "replace") and op["new"] is not None and (merged := _merged_text(row, op, schema)) is not None:
            row = merged
            continue
        if op["if_cond"] and evaluate(from_predicate(op["if_cond"]), row, schema) is not True:
            continue
        if op["unless_cond"] and evaluate(from_predicate(op["unless_cond"]), row, schema) is not False:
            continue
        path, kind = op["path"], op["kind"]
        value = json.loads(op["new"]) if op["new"] is not None else None
        if kind == "log":
            lines.append(value if isinstance(value, str) else json.dumps(value))
            continue
        tokens = parse(path)
        tops = {parse(p)[0] for p in (path, *([op["from_path"]] if kind == "move" and op["from_path"] else [])) if parse(p)}
        fields = [schema[t] for t in tops if t in schema.names]
        if any(tagged(f, IGNORE) for f in fields):
            continue
        try:
            if any(tagged(f, READONLY) or f.name in fixed for f in fields):
                raise Failed(f"{path}: field is read-only")
            if op["strict"] and kind in ("replace", "remove"):
                try:
                    have, dtype = _get(row, schema, tokens, path)
                except Failed:
                    have = _ABSENT
                if have is _ABSENT:
                    raise Failed(f"{path}: strict check can't find the value")
                if have != _converted(json.loads(op["old"]) if op["old"] is not None else None, dtype, path):
                    raise Failed(f"{path}: strict check failed")
            if kind in ("add", "replace"):
                row = _put(row, schema, tokens, value, path)
            elif kind == "remove":
                row = _drop(row, schema, tokens, path)
            else:
                source = parse(op["from_path"] or "")
                value, _ = _get(row, schema, source, op["from_path"])
                if value is _ABSENT:
                    raise Failed(f"{op['from_path']}: there is no value")
                row = _put(_drop(row, schema, source, op["from_path"]) if kind == "move" else row, schema, tokens, value, path)
        except Failed as e:
            errors.append(str(e))
    return row, errors, lines


def _plain(value, dtype: T.DataType):
    """An Arrow value with maps as dicts."""
    if value is None:
        return None
    if isinstance(dtype, T.MapType):
        return {k: _plain(v, dtype.valueType) for k, v in value}
    if isinstance(dtype, T.StructType):
        return {f.name: _plain(value[f.name], f.dataType) for f in dtype}
    return [_plain(v, dtype.elementType) for v in value] if isinstance(dtype, T.ArrayType) else value


def _arrow(value, dtype: T.DataType):
    if value is None:
        return None
    if isinstance(dtype, T.MapType):
        return [(k, _arrow(v, dtype.valueType)) for k, v in value.items()]
    if isinstance(dtype, T.StructType):
        return {f.name: _arrow(value[f.name], f.dataType) for f in dtype}
    return [_arrow(v, dtype.elementType) for v in value] if isinstance(dtype, T.ArrayType) else value


def interpreter(schema: T.StructType, key: list[str], guard: Condition | None) -> Callable:
    """A mapInArrow function over the schema's columns and _ops, the entity's sorted operations."""
    text, texts = pa.string(), pa.list_(pa.string())
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for raw in batch.to_pylist():
                row = {f.name: _plain(raw[f.name], f.dataType) for f in schema}
                told = True if guard is None else evaluate(guard, row, schema)
                if told is not True:
                    done.append((row, "guard_error" if told is None else "guard_failed", [], []))
                    continue
                new, errors, lines = apply_ops(row, raw["_ops"] or [], schema, set(key))
                done.append((new, "error" if errors else "ok", errors, lines))
            cols = [pa.array([_arrow(r[0][f.name], f.dataType) for r in done], kinds.field(f.name).type) for f in schema]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in done], text), pa.array([r[2] for r in done], texts), pa.array([r[3] for r in done], texts)], [*schema.names, "status", "errors", "log"])

    return run


