"""Filters and sort keys on JSON text, as Catalyst expressions over VARIANT."""

from __future__ import annotations

import json
from decimal import Decimal
from functools import reduce
from itertools import product
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from . import jsonvalue

#: Kinds in order of sorting; a missing value has rank 0.
RANKS = {"VOID": 1, "BOOLEAN": 2, "number": 3, "STRING": 4, "ARRAY": 5, "OBJECT": 6}


def last_key_counts(session: SparkSession) -> None:
    """Have VARIANT keep the last of a key that is there twice. A setting of the session, which streams' sessions inherit."""
    session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def document(body: Column) -> Column:
    """VARIANT of JSON text; null where it isn't JSON. Sets :func:`last_key_counts` in the session."""
    session = SparkSession.getActiveSession()
    if session is not None:
        last_key_counts(session)
    return F.try_parse_json(body)


def _steps(segment: str) -> list[str]:
    quote = "'" if "'" not in segment else '"'
    if quote in segment:
        raise InvalidArgument(f"a path segment with both kinds of quotes: {segment}")
    steps = [f"[{quote}{segment}{quote}]"]
    digits = segment.removeprefix("+")
    if digits.isascii() and digits.isdigit() and int(digits) < 2**31:
        steps.append(f"[{int(digits)}]")
    return steps


def at(doc: Column, path: str) -> Column:
    """VARIANT at a dotted path: SQL null if there is none, a VARIANT null for JSON's."""
    ways = ["$" + "".join(x) for x in product(*map(_steps, path.split(".")))]
    return F.coalesce(*[F.try_variant_get(doc, way, "variant") for way in ways])


def tag(node: Column) -> Column:
    return F.schema_of_variant(node)


def is_whole(t: Column) -> Column:
    return (t == "BIGINT") | t.isin("DECIMAL(19,0)", "DECIMAL(20,0)")


def is_number(t: Column) -> Column:
    return (t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL")


def get(node: Column, kind: str) -> Column:
    return F.try_variant_get(node, "$", kind)


def _deep(body: Column, path: str, value: Any) -> Column:
    """Equality with an array or object: VARIANT prints 1.0 as 1, so these are compared in Python."""

    @F.arrow_udf("boolean")
    def same(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                there, found = jsonvalue.lookup(jsonvalue.parse(text), path) if text is not None else (False, None)
            except (ValueError, RecursionError):
                there = False
            out.append(there and jsonvalue.equal(found, value))
        return pa.array(out, pa.bool_())

    return same(body)


def same(node: Column, value: Any) -> Column:
    """Whether a VARIANT equals a scalar."""
    t = tag(node)
    if value is None:
        found = t == "VOID"
    elif isinstance(value, bool):
        found = (t == "BOOLEAN") & (get(node, "boolean") == value)
    elif isinstance(value, str):
        found = (t == "STRING") & (get(node, "string") == value)
    elif isinstance(value, int):
        found = is_whole(t) & (get(node, "decimal(20,0)") == F.lit(Decimal(value)))
    else:
        found = is_number(t) & ~is_whole(t) & (get(node, "double") == value)
    return F.coalesce(found, F.lit(False))


def equals(body: Column, path: str, value: Any) -> Column:
    return _deep(body, path, value) if isinstance(value, list | dict) else same(at(document(body), path), value)


def order(body: Column, path: str, value: Any) -> Column:
    """-1, 0 or 1 of the value at the path against ``value``; SQL null if there is none."""
    node = at(document(body), path)
    t = tag(node)
    if value is None:
        return F.when(t == "VOID", 0).when(t.isNotNull(), 1)
    sign = lambda x, y: F.when(x > y, 1).when(x < y, -1).otherwise(0)
    if isinstance(value, bool):
        kind, cmp = t == "BOOLEAN", sign(get(node, "boolean").cast("int"), F.lit(int(value)))
    elif isinstance(value, int | float):
        kind, cmp = is_number(t), sign(get(node, "double"), F.lit(float(value)))
    elif isinstance(value, str):
        kind, cmp = t == "STRING", sign(get(node, "string"), F.lit(value))
    elif isinstance(value, list):
        kind, cmp = t.startswith("ARRAY"), sign(F.size(get(node, "array<variant>")), F.lit(len(value)))
    else:
        kind, cmp = F.lit(False), F.lit(0)
    return F.when(t == "VOID", -1).when(kind, cmp).when(t.isNotNull(), 0)


def exists(body: Column, path: str) -> Column:
    return at(document(body), path).isNotNull()


def contains(body: Column, path: str, part: str) -> Column:
    node = at(document(body), path)
    return F.coalesce((tag(node) == "STRING") & F.contains(get(node, "string"), F.lit(part)), F.lit(False))


def sort_keys(body: Column, path: str, descending: bool) -> list[Column]:
    """Keys for one path: missing first, then null, booleans, numbers, strings, arrays by length, objects."""
    node = at(document(body), path)
    t = tag(node)
    rank = reduce(lambda col, kind: col.when(t.startswith(kind), RANKS[kind]), ("VOID", "BOOLEAN", "STRING", "ARRAY", "OBJECT"), F.when(is_number(t), RANKS["number"])).otherwise(0)
    keys = [rank, F.when(t == "BOOLEAN", get(node, "boolean")), F.when(is_number(t), get(node, "double")), F.when(t == "STRING", get(node, "string")), F.when(t.startswith("ARRAY"), F.size(get(node, "array<variant>")))]
    return [x.desc() if descending else x.asc() for x in keys]


def canonical(body: Column) -> Column:
    """One text for equal JSON values."""

    @F.arrow_udf("string")
    def same_text(texts: pa.Array) -> pa.Array:
        return pa.array([jsonvalue.canonical(x) for x in texts.to_pylist()], pa.string())

    return same_text(body)


def literal(text: str) -> Any:
    """A filter's value as spelled in a URL: JSON if it is, else the text itself."""
    try:
        return jsonvalue.parse(text)
    except ValueError:
        return text


def dumps(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
