"""Frontmatter of a note: where it ends, and its YAML as Python values.

The reader follows YAML 1.2: ``yes``, ``010``, ``12:30``, ``1_000`` and dates are text,
``1e3`` is a float, ``0o17`` an integer; a repeated key is an error, ``<<`` an ordinary
key, and an unknown tag is dropped.  Frontmatter of plain ``key: value`` lines and
block lists takes a short way that gives the same values.
"""

from __future__ import annotations

import re

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from yaml.resolver import BaseResolver

from .values import FIELDS, WHITE_SPACE, display, to_json, to_number, type_name

OK, ABSENT, INVALID = "ok", "no_frontmatter", "invalid"
_PLAIN_TAG = "plain"


class _Loader(yaml.cyaml.CParser, BaseResolver):
    def __init__(self, stream):
        yaml.cyaml.CParser.__init__(self, stream)
        BaseResolver.__init__(self)

    def resolve(self, kind, value, implicit):
        if kind is yaml.ScalarNode and implicit[0]:
            return _PLAIN_TAG
        return BaseResolver.resolve(self, kind, value, implicit)


_INTEGER = re.compile(r"[-+]?(0|[1-9][0-9]*)\Z")
_BASED = re.compile(r"([-+]?)0([xob])([0-9a-fA-F]+)\Z")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?\Z")
_LEADING_ZERO = re.compile(r"[-+]?0[0-9]")
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
for _sign, _value in (("", float("inf")), ("+", float("inf")), ("-", float("-inf"))):
    _WORDS |= {_sign + word: _value for word in (".inf", ".Inf", ".INF")}
_WORDS |= {word: float("nan") for word in (".nan", ".NaN", ".NAN")}


def _whole(n: int) -> int | float:
    return n if -(1 << 63) <= n < 1 << 63 else float(n)


def plain_scalar(text: str) -> object:
    """The value of an unquoted scalar."""
    if text in _WORDS:
        return _WORDS[text]
    if text[0] not in "+-.0123456789":
        return text
    if _INTEGER.match(text):
        return _whole(int(text))
    if m := _BASED.match(text):
        try:
            return _whole(int(m[1] + m[3], {"x": 16, "o": 8, "b": 2}[m[2]]))
        except ValueError:
            return text
    if _FLOAT.match(text) and not _LEADING_ZERO.match(text):
        return float(text)
    return text


def _value(node: yaml.Node, above: tuple[int, ...] = ()) -> object:
    if id(node) in above:
        raise yaml.YAMLError("recursive alias")
    if isinstance(node, yaml.ScalarNode):
        return plain_scalar(node.value) if node.tag == _PLAIN_TAG else node.value
    above = (*above, id(node))
    if isinstance(node, yaml.SequenceNode):
        return [_value(x, above) for x in node.value]
    out: dict[object, object] = {}
    for key_node, value_node in node.value:
        key = _value(key_node, above)
        token = (type(key).__name__, repr(key))
        if token in out:
            raise yaml.YAMLError("repeated key")
        out[token] = (key, _value(value_node, above))
    if len(above) == 1:  # top level: only text keys are fields
        return {k: v for k, v in out.values() if isinstance(k, str)}
    return {k if isinstance(k, str) else "": v for k, v in out.values()}


def read_yaml(text: str) -> dict[str, object]:
    """Fields of a YAML mapping; ValueError if it is anything else."""
    try:
        node = _Loader(text).get_single_node()
        if node is None:
            return {}
        value = _value(node)
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        raise ValueError(f"not a YAML mapping: {e}") from e
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ValueError("not a YAML mapping")
    return value


# Lines that mean the same with or without a YAML parser: a word key or a list item, and
# a value of word characters, dots, slashes and inner dashes or spaces, or one in quotes
# without an escape.  A key may also hold a flow map as JSON writes it: quoted word keys,
# and values that are single words or printable ASCII in quotes, without an escape.
_VALUE = r"""([\w.+-](?:[\w./+ -]*[\w./+-])?)|"([^"\\]*)"|'([^']*)'"""
_PAIR = r'''"[A-Za-z_][\w-]{0,99}": (?:[+-]?[\w.][\w.+-]*|"[ !#-\[\]-~]*")'''
_FLOW = rf"\{{(?:{_PAIR}(?:, {_PAIR})*)?\}}"
_SIMPLE = re.compile(rf"(?:([A-Za-z_][\w-]*):(?: (?:{_VALUE}|({_FLOW})))?|  - (?:{_VALUE}))\Z")
_PAIRS = re.compile(r'''"([\w-]+)": (?:([\w.+-]+)|"([^"]*)")''')


def read_fields(text: str) -> dict[str, object]:
    """``read_yaml``, with a short way for plain lines and block lists."""
    if not text.isascii():
        return read_yaml(text)
    out: dict[str, object] = {}
    key, items = None, None  # the key of the last line but items, and its list, if it has no value
    for line in text.split("\n"):
        m = _SIMPLE.match(line)
        if m is None:
            return read_yaml(text)
        name, plain, double, single, flow, item, item_double, item_single = m.groups()
        if name is not None:
            if name in out or name in _WORDS:
                return read_yaml(text)
            key, items = name, None
            if plain is not None:
                if plain[0] == "-" and plain[1:2] in ("", " "):
                    return read_yaml(text)
                out[key] = plain_scalar(plain)
            elif double is not None or single is not None:
                out[key] = double if double is not None else single
            elif flow is not None:
                pairs = _PAIRS.findall(flow)
                out[key] = {k: plain_scalar(word) if word else quoted for k, word, quoted in pairs}
                if len(out[key]) < len(pairs):  # a repeated key
                    return read_yaml(text)
            else:
                out[key], items = None, []
        else:
            if items is None or item is not None and item[0] == "-" and item[1:2] in ("", " "):
                return read_yaml(text)
            items.append(plain_scalar(item) if item is not None else item_double if item_double is not None else item_single)
            out[key] = items
    return out


def split_note(text: str) -> tuple[str, int] | None:
    """(YAML text, place of the body), both counted without a leading byte-order mark."""
    text = text.removeprefix("\ufeff")
    m = re.match(r"---(\r?\n)", text)
    if not m:
        return None
    start = m.end()
    if empty := re.compile(r"---(\n|\r\n|\Z)").match(text, start):
        return "", empty.end()
    ends = [(at, at + len(p)) for p in ("\n---\n", "\n---\r\n") if (at := text.find(p, start)) >= 0]
    # Without a newline after it, only the first candidate may close, at the very end.
    if (at := text.find("\n---", start)) >= 0 and at + 4 == len(text):
        ends.append((at, at + 4))
    if not ends:
        return None
    stop, body = min(ends)
    return text[start:stop], body


def read_note(text: str) -> tuple[str, int, dict[str, object]]:
    """(status, bytes of the trimmed body, fields)."""
    split = split_note(text)
    if split is None:
        return ABSENT, len(text.strip(WHITE_SPACE).encode()), {}
    yaml_text, body = split
    raw = text.encode()
    offset = len(text.removeprefix("\ufeff")[:body].encode())
    size = len(raw[offset:].decode(errors="ignore").strip(WHITE_SPACE).encode())
    try:
        fields = read_fields(yaml_text) if yaml_text.strip(WHITE_SPACE) else {}
    except ValueError:
        return INVALID, size, {}
    return OK, size, fields


_ITEM = pa.struct([("type", pa.string()), ("disp", pa.string())])
_CELL = pa.struct([("type", pa.string()), ("disp", pa.string()), ("num", pa.float64()), ("items", pa.list_(_ITEM)), ("json", pa.string())])
NOTE_DDL = f"status string, body_length long, fields {FIELDS}"


def _parse(texts: pa.Array) -> pa.Array:
    """Columns are built from flat lists: one entry for each field, one for each list item."""
    status, lengths, ends, keys = [], [], [0], []
    kinds, texts_of, numbers, jsons, item_ends, is_list, item_kinds, item_texts = [], [], [], [], [0], [], [], []
    for text in texts.to_pylist():
        state, length, fields = read_note(text or "")
        status.append(state)
        lengths.append(length)
        for key, value in fields.items():
            keys.append(key)
            kinds.append(type_name(value))
            texts_of.append(display(value))
            numbers.append(to_number(value))
            jsons.append(to_json(value))
            is_list.append(isinstance(value, list))
            if is_list[-1]:
                item_kinds += map(type_name, value)
                item_texts += map(display, value)
            item_ends.append(len(item_kinds))
        ends.append(len(keys))
    item = pa.StructArray.from_arrays([pa.array(item_kinds, pa.string()), pa.array(item_texts, pa.string())], fields=list(_ITEM))
    offsets = pa.array([e if there else None for e, there in zip(item_ends, is_list)] + item_ends[-1:], pa.int32())
    cells = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts_of, pa.string()), pa.array(numbers, pa.float64()), pa.ListArray.from_arrays(offsets, item), pa.array(jsons, pa.string())], fields=list(_CELL))
    fields_of = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), cells)
    return pa.StructArray.from_arrays([pa.array(status, pa.string()), pa.array(lengths, pa.int64()), fields_of], ["status", "body_length", "fields"])


def parsed(content: Column) -> Column:
    """A struct column (status, body_length, fields) of note texts."""
    # Non-deterministic for the optimiser only: else a filter on a field would parse twice.
    return F.arrow_udf(_parse, NOTE_DDL).asNondeterministic()(content)


# The short way of ``read_fields`` as one pattern, for the JVM: groups are possessive, so
# that its matcher neither recurses nor goes back, however long the frontmatter is.
_JVM_VALUE = r"""(?:(?!-[ \n])[\w.+-](?:[\w./+ -]*[\w./+-])?|"[\x00-\x7F&&[^"\\\n]]*"|'[\x00-\x7F&&[^'\n]]*')"""
# Of a flow map, up to 32 pairs are told here; the look-ahead keeps repeated keys out.
_JVM_PAIR = r'''"([A-Za-z_][\w-]{0,99})": (?![^\n]*"\1": )(?:[+-]?[\w.][\w.+-]*+|"[ !#-\[\]-~]*")'''
_JVM_FLOW = r"\{(?:" + _JVM_PAIR + r'''(?:, (?=")|(?=\}))){0,32}+\}'''
_JVM_KEY = "(?!(?:" + "|".join(w for w in _WORDS if w.isalpha()) + r"):)[A-Za-z_][\w-]*:"
_JVM_PLAIN = rf"\A---\n(?:{_JVM_KEY}(?: (?:{_JVM_VALUE}|{_JVM_FLOW})\n|\n(?:  - {_JVM_VALUE}\n)*+))*+---(?:\n|\z)"
_JVM_MARK = r"\A\x{FEFF}?---\r?\n"


def invalid(content: Column) -> Column:
    """Whether the frontmatter can't be parsed.

    Texts without a mark, and those with plain lines and distinct keys, are told by the
    JVM; only others go through Python.
    """
    head = F.regexp_extract(content, _JVM_PLAIN, 0)
    keys = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w-]*):"), 1)
    fine = content.isNull() | ~content.rlike(_JVM_MARK) | ((head != "") & (F.size(keys) == F.size(F.array_distinct(keys))))
    return F.coalesce(F.arrow_udf(_invalid, "boolean").asNondeterministic()(F.when(~fine, content)), F.lit(False))


def _invalid(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else read_note(t)[0] == INVALID for t in texts.to_pylist()], pa.bool_())
