"""JSON values as the engine compares them.

Whole numbers and fractions are different kinds under equality (``1`` is not ``1.0``) but one kind in order.
Objects are equal whatever the order of their keys. Whole numbers outside 64 bits (signed or unsigned) are
floating point. Values of different kinds compare as equal in order, except that null is below all others.
"""

from __future__ import annotations

import json
import math
from typing import Any


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


def _whole(text: str) -> int | float:
    value = int(text)
    return value if -(2**63) <= value < 2**64 else float(value)


def parse(text: str) -> Any:
    return json.loads(text, parse_int=_whole, parse_constant=_no_constant)


def equal(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return type(a) is type(b) and a == b


def lookup(value: Any, path: str) -> tuple[bool, Any]:
    """(whether the dotted path leads to something, what). Segments are keys of objects and places in arrays."""
    for segment in path.split("."):
        if isinstance(value, dict) and segment in value:
            value = value[segment]
        elif isinstance(value, list) and (digits := segment.removeprefix("+")).isascii() and digits.isdigit() and int(digits) < len(value):
            value = value[int(digits)]
        else:
            return False, None
    return True, value


def compare(a: Any, b: Any) -> int:
    """-1, 0 or 1."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    for kind in (bool, str):
        if isinstance(a, kind) and isinstance(b, kind):
            return (a > b) - (a < b)
    if all(isinstance(x, int | float) and not isinstance(x, bool) for x in (a, b)):
        a, b = float(a), float(b)
        return (a > b) - (a < b)
    if isinstance(a, list) and isinstance(b, list):
        return (len(a) > len(b)) - (len(a) < len(b))
    return 0


def canonical(text: str | None) -> str | None:
    """One text for equal values, in ASCII, so that lone surrogates have one too; text that isn't JSON stays as it is."""
    if text is None:
        return None

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            return 0.0 if x == 0 else x
        if isinstance(x, list):
            return [plain(y) for y in x]
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

    try:
        value = parse(text)
        return json.dumps(plain(value), sort_keys=True, separators=(",", ":")) if not isinstance(value, float) or math.isfinite(value) else text
    except (ValueError, RecursionError):
        return text
