"""The JSON-Schema subset that tables can be bound to, for single values and compiled to expressions over VARIANT.

Keywords: type, required, properties, additionalProperties, items, enum, const, minLength, maxLength, minimum,
maximum, minItems, maxItems, pattern, oneOf. Any other is ignored. A whole number is one written without
fraction or exponent. The first fault is reported: oneOf, type, const, enum, then what the kind has; in an object
names that are missing (in the schema's order), known ones by name, then others by name. Paths start with ``$``.

A keyword is one :class:`Rule` with two readings, of a Python value and of a column. :func:`first_fault` is built of
the second, so that a table is checked without leaving the JVM; schemas that need equality with arrays or objects, or
names that no path can spell, are checked by the first in an Arrow function.

Patterns are regular expressions without look-around, back references or atomic groups, which are faults; ``$`` is the
end of the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaViolation
from . import jsonexpr, jsonvalue

Fault = tuple[str, str]


class NotColumns(Exception):
    """A schema that needs the Python reading."""


def kind_of(value: Any) -> str:
    for kind, types in (("null", type(None)), ("boolean", bool), ("integer", int), ("fraction", float), ("string", str), ("array", list)):
        if isinstance(value, types):
            return kind
    return "object"


#: A kind's tag of a VARIANT column.
_TAGS: dict[str, Callable[[Column], Column]] = {
    "null": lambda t: t == "VOID",
    "boolean": lambda t: t == "BOOLEAN",
    "integer": jsonexpr.is_whole,
    "fraction": lambda t: jsonexpr.is_number(t) & ~jsonexpr.is_whole(t),
    "string": lambda t: t == "STRING",
    "array": lambda t: t.startswith("ARRAY"),
    "object": lambda t: t.startswith("OBJECT"),
}
_NUMBERS = ("integer", "fraction")


def _tagged(node: Column, kinds: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [_TAGS[k](jsonexpr.tag(node)) for k in kinds], F.lit(False))


@dataclass(frozen=True)
class Rule:
    """What is wrong with a value of some ``kinds`` (None: any), and the message."""

    kinds: tuple[str, ...] | None
    wrong: Callable[[Any], bool]
    column: Callable[[Column], Column]
    message: str


def _scalar(value: Any) -> Any:
    if isinstance(value, list | dict):
        raise NotColumns
    return value


def _numbers(schema: dict, *names: str, count: bool = False) -> Iterator[tuple[str, Any]]:
    """Keywords that hold a number; as a count, one that can be."""
    for name in names:
        limit = schema.get(name)
        if isinstance(limit, int if count else int | float) and not isinstance(limit, bool) and (not count or limit >= 0):
            yield name, limit


def rules(schema: dict) -> Iterator[Rule]:
    """The keywords that look at a value alone, in order."""
    if "type" in schema:
        named = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        kinds = tuple(k for x in named if isinstance(x, str) for k in (_NUMBERS if x == "number" else (x,)) if k in _TAGS and x != "fraction")
        yield Rule(None, lambda v: kind_of(v) not in kinds, lambda c: ~_tagged(c, kinds), f"is not of type {schema['type']}")
    if "const" in schema:
        const = schema["const"]
        yield Rule(None, lambda v: not jsonvalue.equal(const, v), lambda c: ~jsonexpr.same(c, _scalar(const)), "is not the constant")
    if isinstance(schema.get("enum"), list):
        values = schema["enum"]
        yield Rule(None, lambda v: not any(jsonvalue.equal(x, v) for x in values), lambda c: ~reduce(Column.__or__, [jsonexpr.same(c, _scalar(x)) for x in values], F.lit(False)), "is not one of the values")
    for name, n in _numbers(schema, "minItems", "maxItems", "minLength", "maxLength", count=True):
        low, items = name.startswith("min"), name.endswith("Items")
        size = (lambda c: F.size(jsonexpr.get(c, "array<variant>"))) if items else (lambda c: F.char_length(jsonexpr.get(c, "string")))
        yield Rule(("array",) if items else ("string",), lambda v, n=n, low=low: len(v) < n if low else len(v) > n, lambda c, n=n, low=low, size=size: size(c) < n if low else size(c) > n, f"{'has' if items else 'is'} {'under' if low else 'over'} {n} {'items' if items else 'characters'}")
    if isinstance(schema.get("pattern"), str):
        try:
            python, java = spelled(schema["pattern"])
            yield Rule(("string",), lambda v: not regex.search(python, v), lambda c: ~jsonexpr.get(c, "string").rlike(java), "does not match the pattern")
        except (ValueError, regex.error) as e:
            yield Rule(("string",), lambda v: True, lambda c: F.lit(True), f"the pattern is not one: {e}")
    for name, n in _numbers(schema, "minimum", "maximum"):
        low, n = name == "minimum", float(n)
        yield Rule(_NUMBERS, lambda v, n=n, low=low: float(v) < n if low else float(v) > n, lambda c, n=n, low=low: jsonexpr.get(c, "double") < n if low else jsonexpr.get(c, "double") > n, f"is {'below' if low else 'above'} {n:g}")


def spelled(pattern: str) -> tuple[str, str]:
    """The pattern for Python and for Java; ValueError for what backtracking engines alone have."""
    python, java, at, inside = "", "", 0, False
    while at < len(pattern):
        c, two = pattern[at], pattern[at : at + 2]
        if c == "\\":
            if len(two) < 2 or (not inside and (two[1] in "123456789kgGXRZ")):
                raise ValueError(f"{two} at {at}")
            end = two if two != "\\z" else "\\Z"
            python, java, at = python + end, java + two, at + 2
            continue
        if not inside and two == "(?":
            opened = re.match(r"\(\?(P?<(?P<name>[A-Za-z_]\w*)>|:|[a-z]*(-[a-z]+)?[:)])", pattern[at:])
            if not opened:
                raise ValueError(f"{pattern[at : at + 4]} at {at}")
            name = opened["name"]
            python += f"(?P<{name}>" if name else opened[0]
            java += f"(?<{name.replace('_', '0')}>" if name else opened[0]
            at += opened.end()
            continue
        if c == "[" and not inside:
            inside = True
            first = re.match(r"\[\^?\]?", pattern[at:])[0]
            python, java, at = python + first, java + first.replace("]", "\\]"), at + len(first)
            continue
        inside = inside and c != "]"
        python += "\\Z" if c == "$" and not inside else c
        java += "\\z" if c == "$" and not inside else c
        at += 1
    regex.compile(python)
    return python, f"(?U){java}"


def _names(schema: dict) -> list[str]:
    found = schema.get("required")
    return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []


def _known(schema: dict) -> dict:
    found = schema.get("properties")
    return found if isinstance(found, dict) else {}


def missing(schema: Any, value: Any, path: str = "$") -> list[Fault]:
    return [(f"{path}.{x}", "is missing") for x in _names(schema) if x not in value] if isinstance(schema, dict) and isinstance(value, dict) else []


def _all(schema: Any, value: Any, path: str) -> Iterator[Fault]:
    """Faults in order."""
    if not isinstance(schema, dict):
        return
    if "oneOf" in schema:
        choices = schema["oneOf"]
        n = sum(fault(x, value, path) is None for x in choices) if isinstance(choices, list) else None
        if n != 1:
            yield path, "oneOf is not a list" if n is None else f"matches {n} of oneOf instead of one"
    kind = kind_of(value)
    yield from ((path, r.message) for r in rules(schema) if (r.kinds is None or kind in r.kinds) and r.wrong(value))
    if kind == "array" and "items" in schema:
        for i, x in enumerate(value):
            yield from _all(schema["items"], x, f"{path}[{i}]")
    elif kind == "object":
        yield from missing(schema, value, path)
        known, more = _known(schema), schema.get("additionalProperties")
        for x in sorted(known.keys() & value.keys()):
            yield from _all(known[x], value[x], f"{path}.{x}")
        for x in sorted(value.keys() - known.keys()):
            yield from [(f"{path}.{x}", "is not allowed")] if more is False else _all(more, value[x], f"{path}.{x}")


def fault(schema: Any, value: Any, path: str = "$") -> Fault | None:
    """(path, message) of the first violation, or None."""
    return next(_all(schema, value, path), None)


def faults(schema: Any, value: Any) -> list[Fault]:
    """All missing names of the root, or else the first violation."""
    return missing(schema, value) or [x for x in [fault(schema, value)] if x]


def validate(schema: Any, value: Any) -> None:
    if found := fault(schema, value):
        raise SchemaViolation(*found)


_FAULT = "struct<path:string,message:string>"


def _struct(path: Column, message: Column | str) -> Column:
    return F.struct(path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _first(found: Column) -> Column:
    """The first that isn't null of an array."""
    return F.get(F.array_compact(found), F.lit(0))


def compiled(schema: Any, node: Column, path: Column) -> Column:
    """The first fault of a VARIANT, as a struct; null if there is none."""
    none = F.lit(None).cast(_FAULT)
    if not isinstance(schema, dict):
        return none
    out = []
    if "oneOf" in schema:
        choices = schema["oneOf"]
        if not isinstance(choices, list):
            return _struct(path, "oneOf is not a list")
        n = reduce(Column.__add__, [compiled(x, node, path).isNull().cast("int") for x in choices], F.lit(0))
        out.append(F.when(n != 1, _struct(path, F.concat(F.lit("matches "), n.cast("string"), F.lit(" of oneOf instead of one")))))
    for rule in rules(schema):
        wrong = rule.column(node) if rule.kinds is None else _tagged(node, rule.kinds) & rule.column(node)
        out.append(F.when(wrong, _struct(path, rule.message)))
    if "items" in schema:
        each = F.transform(jsonexpr.get(node, "array<variant>"), lambda x, i: compiled(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        out.append(F.when(_tagged(node, ("array",)), _first(each)))
    known, more, inside = _known(schema), schema.get("additionalProperties"), []
    for name in _names(schema):
        inside.append(F.when(_child(node, name).isNull(), _struct(_under(path, name), "is missing")))
    for name in sorted(known):
        child = _child(node, name)
        inside.append(F.when(child.isNotNull(), compiled(known[name], child, _under(path, name))))
    if more is False or isinstance(more, dict):
        entries = jsonexpr.get(node, "map<string,variant>")
        names = F.array_sort(F.array_except(F.map_keys(entries), F.array(*map(F.lit, known)).cast("array<string>")))
        fault_of = (lambda x: _struct(F.concat(path, F.lit("."), x), "is not allowed")) if more is False else (lambda x: compiled(more, entries[x], F.concat(path, F.lit("."), x)))
        inside.append(_first(F.transform(names, fault_of)))
    if inside:
        out.append(F.when(_tagged(node, ("object",)), F.coalesce(*inside, none)))
    return F.coalesce(*out, none)


def _under(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}"))


def _child(node: Column, name: str) -> Column:
    if "'" in name and '"' in name:
        raise NotColumns
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(node, f"$[{quote}{name}{quote}]", "variant")


def first_fault(schema: Any, body: Column) -> Column:
    """struct<path,message> of each JSON text's first violation, null if it is valid."""
    broken = _struct(F.lit("$"), "is not JSON")
    try:
        # the element of an array of one, so that a text is parsed once
        one = F.transform(F.array(jsonexpr.document(body)), lambda doc: F.when(doc.isNull(), broken).otherwise(compiled(schema, doc, F.lit("$"))))
        return F.get(one, F.lit(0))
    except NotColumns:
        return _by_values(schema, body)


def _by_values(schema: Any, body: Column) -> Column:
    text = lambda x: x.encode("utf-8", "backslashreplace").decode()  # noqa: E731  names may hold lone surrogates

    @F.arrow_udf(_FAULT)
    def check(texts: pa.Array) -> pa.Array:
        out = []
        for body in texts.to_pylist():
            try:
                found = fault(schema, jsonvalue.parse(body)) if body is not None else ("$", "is not JSON")
            except (ValueError, RecursionError):
                found = ("$", "is not JSON")
            out.append({"path": text(found[0]), "message": text(found[1])} if found else None)
        return pa.array(out, pa.struct([("path", pa.string()), ("message", pa.string())]))

    return check(body)
