"""Field values: the ``cell`` struct, its Python form in the parser, and text helpers.

A cell carries what the operators use: ``type`` (null, string, integer, float, bool,
list or map), ``disp`` (display text), ``num`` (numeric value, also of numeric text),
``items`` (of a list) and ``json``.
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = "struct<type: string, disp: string>"
CELL = f"struct<type: string, disp: string, num: double, items: array<{ITEM}>, json: string>"
FIELDS = f"map<string, {CELL}>"

#: White space as Unicode defines it (fixed).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Text that counts as a number; no white space, no type suffix.
NUMBER = r"^[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"
_NUMBER = re.compile(NUMBER[:-1] + r"\Z", re.IGNORECASE | re.ASCII)


def parse_number(text: str) -> float | None:
    return float(text) if text[:1] in _NUMBER_STARTS and _NUMBER.match(text) else None


_NUMBER_STARTS = frozenset("+-.0123456789iInN")


def number_of(text: Column) -> Column:
    """The number that a text spells, else null."""
    plain = text.rlike("(?i)" + NUMBER[:-1] + r"\z")
    nan = text.rlike(r"(?i)^[+-]?nan\z")
    return F.when(nan, F.lit(float("nan"))).when(plain, text.try_cast("double"))


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def float_text(x: float) -> str:
    """Shortest decimal digits, never an exponent, no ``.0``."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    text = repr(x)
    if "e" in text:
        text = format(Decimal(text), "f")
    return text[:-2] if text.endswith(".0") else text


def float_text_column(x: Column) -> Column:
    """``float_text`` of a double column, for values below 1e38."""
    text, size = x.cast("string"), F.abs(x)
    digits = lambda kind: x.try_cast(kind).cast("string")
    # Only text with an exponent takes this way; the scale leaves room for all its digits.
    long = F.when(size >= 1e20, digits("decimal(38,0)")).when(size >= 1, F.regexp_replace(digits("decimal(38,9)"), r"\.?0+$", "")).otherwise(F.regexp_replace(digits("decimal(38,37)"), "0+$", ""))
    return (
        F.when(F.isnan(x), "NaN")
        .when(text == "Infinity", "inf")
        .when(text == "-Infinity", "-inf")
        .when(text.contains("E"), long)
        .otherwise(F.regexp_replace(text, r"\.0$", ""))
    )


# --- Python values of the parser -------------------------------------------------


_TYPE_NAMES = {type(None): "null", bool: "bool", int: "integer", float: "float", str: "string", list: "list", dict: "map"}


def type_name(value: object) -> str:
    return _TYPE_NAMES[type(value)]


def display(value: object) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return float_text(value)
    if isinstance(value, list):
        return ", ".join(map(display, value))
    if isinstance(value, dict):
        return ", ".join(f"{k}: {display(value[k])}" for k in sorted(value))
    return str(value)


def to_number(value: object) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    return parse_number(value) if isinstance(value, str) else None


_PLAIN_TEXT = re.compile(r"[ !#-\[\]-~]*\Z")


def to_json(value: object) -> str:
    """Compact JSON, keys in order; what JSON has no number for becomes null."""
    if isinstance(value, str):
        return f'"{value}"' if _PLAIN_TEXT.match(value) else json.dumps(value, ensure_ascii=False)
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return f"[{','.join(map(to_json, value))}]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{to_json(k)}:{to_json(value[k])}" for k in sorted(value)) + "}"
    return repr(value) if isinstance(value, int) or math.isfinite(value) else "null"


def to_cell(value: object) -> dict:
    items = [{"type": type_name(x), "disp": display(x)} for x in value] if isinstance(value, list) else None
    return {"type": type_name(value), "disp": display(value), "num": to_number(value), "items": items, "json": to_json(value)}


def percent_decoded(text: Column) -> Column:
    """``%XX`` as the Latin-1 character of its byte; a malformed escape stays as it is."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)%.{0,2}|[^%]+"), 0)
    digits = lambda p: F.regexp_replace(F.substring(p, 2, 2), r"^\+", "")
    good = lambda p: p.rlike(r"^%([0-9a-fA-F]{2}|\+[0-9a-fA-F])$")
    decoded = F.transform(parts, lambda p: F.when(good(p), F.char(F.conv(digits(p), 16, 10).try_cast("int"))).otherwise(p))
    return F.when(text.contains("%"), F.array_join(decoded, "")).otherwise(text)
