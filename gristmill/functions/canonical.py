"""Canonical JSON: one text for equal values, whatever the order of keys."""

from __future__ import annotations

import hashlib
import json
import math
from json.encoder import encode_basestring as _quoted

from pyspark.sql import Column

from .batches import sliced


def number(x: float | int) -> str:
    """As scripts print numbers: no `.0`, the shortest digits that read back, exponents from 1e21 and below 1e-6."""
    if isinstance(x, int):
        return str(x)
    if x == 0:
        return "0"
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    mantissa, _, exponent = text.partition("e")
    if not exponent:
        return text if abs(x) >= 1e-6 else text
    e = int(exponent)
    if -7 < e < 0:
        return f"{x:.{len(mantissa.replace('.', '').replace('-', '')) - 1 - e}f}"
    return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def units(key: str) -> bytes:
    """The order of keys by UTF-16 units."""
    return key.encode("utf-16-be", "surrogatepass")


def folded(key: str) -> tuple:
    """Locale-like order of keys: letters without case first, lower before upper."""
    return (key.casefold(), [c.isupper() for c in key], key)


def _sorted(value: dict, order) -> list[str]:
    """The keys in order; without a call for each where they are ASCII, which UTF-16 units order alike."""
    return sorted(value) if order is units and "".join(value).isascii() else sorted(value, key=order)


def dumps(value, order=units) -> str:
    kind = type(value)
    if kind is str:
        return _quoted(value)
    if kind is int:
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join([f"{_quoted(k)}:{dumps(value[k], order)}" for k in _sorted(value, order)]) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join([dumps(x, order) for x in value]) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number(value)
    return json.dumps(value, ensure_ascii=False)


def stable(value) -> str:
    """The value with its types, for comparing proposals: 1 and "1" differ, as do null and no value."""
    if isinstance(value, str):
        return f'["string",{_quoted(value)}]'
    if value is None:
        return '["null"]'
    if isinstance(value, bool):
        return '["boolean",true]' if value else '["boolean",false]'
    if isinstance(value, (int, float)):
        if isinstance(value, float) and not math.isfinite(value):
            return '["number","NaN"]' if math.isnan(value) else '["number","Infinity"]' if value > 0 else '["number","-Infinity"]'
        return f'["number",{number(value)}]'
    if isinstance(value, (list, tuple)):
        return f'["array",[{",".join([stable(x) for x in value])}]]'
    return f'["object",[{",".join([f"[{_quoted(k)},{stable(value[k])}]" for k in _sorted(value, units)])}]]'


def digest(value, order=units) -> str:
    return hashlib.sha256(dumps(value, order).encode()).hexdigest()


def _canonical(raw: str | None) -> str:
    if raw is None:
        return stable(None)
    try:
        return stable(json.loads(raw))
    except ValueError:
        return stable(raw)


def canonical_value(raw: Column) -> Column:
    """The stable form of JSON texts; a text that isn't JSON counts as a string."""
    return sliced(lambda raw: [_canonical(x) for x in raw], "string")(raw)
