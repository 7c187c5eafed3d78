"""Splitting and parsing of frontmatter."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from notegraph.functions import frontmatter
from notegraph.functions.frontmatter import ABSENT, INVALID, OK, invalid, read_fields, read_note, read_yaml, split_note
from notegraph.functions.values import display, float_text, parse_number, to_cell, to_json, to_number, type_name


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("---\na: 1\n---\nbody", ("a: 1", 13)),
        ("---\r\na: 1\r\n---\r\nbody", ("a: 1\r", 16)),
        ("---\na: 1\n---", ("a: 1", 12)),
        ("---\n---\nBody.\n", ("", 8)),
        ("---\r\n---\r\n", ("", 10)),
        ("---\n---", ("", 7)),
        ("﻿---\na: 1\n---\nx", ("a: 1", 13)),
        ("# heading", None),
        ("--- \na: 1\n---\n", None),
        ("---\na: 1\n", None),
        ("---\na: 1\n--- \n", None),
        ("---\na: 1\n---x\nb: 2\n---", None),  # a first candidate that does not close hides the one at the end
        ("", None),
    ],
)
def test_split(text, wanted):
    assert split_note(text) == wanted


def test_types_of_plain_scalars():
    fields = read_yaml("a: yes\nb: 010\nc: 12:30\nd: 1_000\ne: 2024-01-01\nf: 1e3\ng: 0o17\nh: true\ni: ~\nj: 8.0\nk: 18446744073709551615\nl: '7'\nm: !x tagged\nn: .inf\no: 0x1F\np: -3\nq: +5\nr: .5")
    assert fields == {"a": "yes", "b": "010", "c": "12:30", "d": "1_000", "e": "2024-01-01", "f": 1000.0, "g": 15, "h": True, "i": None, "j": 8.0, "k": 1.8446744073709552e19, "l": "7", "m": "tagged", "n": math.inf, "o": 31, "p": -3, "q": 5, "r": 0.5}
    assert [type_name(fields[k]) for k in "aehijgl"] == ["string", "string", "bool", "null", "float", "integer", "string"]


def test_mapping_rules():
    assert read_yaml("<<: {a: 1}\nb: 2") == {"<<": {"a": 1}, "b": 2}
    assert read_yaml("1: x\nb: 2") == {"b": 2}  # other keys than text are dropped
    assert read_yaml("m: {1: x, k: y}") == {"m": {"": "x", "k": "y"}}
    assert read_yaml("") == {} and read_yaml("# only a comment") == {} and read_yaml("~") == {}
    for bad in ("a: 1\na: 2", "- list", "text", "a: [1", "a: 1\n---\nb: 2", "a: *missing"):
        with pytest.raises(ValueError):
            read_yaml(bad)


def test_display_and_numbers():
    assert display([1, "a", None, True, 2.50]) == "1, a, , true, 2.5"
    assert display({"b": 1, "a": [2, 3]}) == "a: 2, 3, b: 1"
    assert [float_text(x) for x in (8.0, 0.1, 1e21, 1e-7, math.inf, math.nan, -0.0)] == ["8", "0.1", "1000000000000000000000", "0.0000001", "inf", "NaN", "-0"]
    assert [parse_number(x) for x in (".5", "5.", "1e5", "+7", "1.e3", "-inf", "Infinity")] == [0.5, 5.0, 1e5, 7.0, 1e3, -math.inf, math.inf]
    assert [parse_number(x) for x in ("1d", " 5", ".", "1_0", "", "0x1", "５")] == [None] * 7
    assert to_number(True) is None and to_number("007") == 7.0
    assert to_json({"b": [1, 8.0], "a": math.nan}) == '{"a":null,"b":[1,8.0]}'
    assert to_cell(["x", 1])["items"] == [{"type": "string", "disp": "x"}, {"type": "integer", "disp": "1"}]


def test_note_status_and_body_length():
    assert read_note("---\na: 1\n---\n\n  böd 　\n") == (OK, 4, {"a": 1})
    assert read_note(" no frontmatter \n") == (ABSENT, 14, {})
    assert read_note("---\na: [\n---\nx") == (INVALID, 1, {})
    assert read_note("---\n \n---\nx")[0] == OK
    assert read_note("") == (ABSENT, 0, {})


words = st.text(st.sampled_from("ab1 -.0e/_x"), max_size=8)
line = st.one_of(st.builds("{}: {}".format, st.sampled_from(["a", "b", "key_1", "null", "x-y"]), words), st.builds("  - {}".format, words), st.sampled_from(["tags:", "a:", "", "yes: no", "c: 'q'", "- z", "# c"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(line, max_size=5).map("\n".join))
def test_short_way_equals_the_parser(text):
    def outcome(read):
        try:
            return repr(read(text))
        except ValueError:
            return "invalid"

    assert outcome(read_fields) == outcome(read_yaml)


CASES = ["a: 1", "a: 1\na: 2", "a:\n  - x\n  - y", "  - x", "a: 1\n  - x", "a: - x", "a: -", "a: -5", 'q: "x \\" y"', 'q: "plain"', "q: 'it\\'", "null: 1", "nullable: 1", "true: 1", "é: 1", "a: é", "a: [1", "a: {b: 1}", "a: x: y", "a: x #c", "a:", "a:\n\nb: 1", "- a", "text", "", "a: 1\r", 'a: "x\ry: 1"', "a: 'b'\nc: 1.5e3\nd-e: f/g h", "a: *x", "a:\n  - - x", "k: v\n" * 2, "\n".join(f"k{i}: v" for i in range(3000)), "l:\n" + "  - x\n" * 3000 + "m: 1", 'long: "' + "x" * 100_000 + '"']
FORMS = ["---\n{}\n---\nbody", "---\n{}\n---", "---\r\n{}\r\n---\r\n", "\ufeff---\n{}\n---\n", "{}", "---\n{}", "---\n{}\n---\n---\n{}\n---\n"]


def test_the_jvm_tells_the_same_notes_invalid(spark):
    texts = [f.replace("{}", c) for f in FORMS for c in CASES] + [None, "", "---\n---", "---\n---\n", "---", "---\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(3)
    got = {r["n"]: r["i"] for r in df.select("n", invalid(F.col("t")).alias("i")).collect()}
    for n, text in enumerate(texts):
        assert got[n] == (read_note(text or "")[0] == INVALID), text


FLOWS = ['{"k": 76}', "{}", '{"a": 1, "b": "x, y: z", "c": true, "d": -3.5e1}', '{"a": "", "null": null}', '{"a": 1, "a": 2}', '{"a": 1, "b": 2, "a": 3}', '{"a": 1,}', '{"a": 1, }', '{"a":1}', '{"a": -}', '{"a": .}', '{"a": {"b": 1}}', '{"a": [1]}', '{"a": "q\\"q"}', '{"a": "é"}', '{"a": 1} x', '{"a": 1', '{a: 1}', '{"a": "a"}', '{"a": "\t"}']
SHORT = 4  # so many of them need no parser


def test_flow_maps_as_json_writes_them_need_no_parser(spark, monkeypatch):
    def outcome(read, text):
        try:
            return repr(read(text))
        except ValueError:
            return "invalid"

    many = ["{" + ", ".join(f'"k{i}": {i}' for i in range(n)) + "}" for n in (32, 33)]
    repeated = many[0][:-1] + ', "k1": 2}'
    texts = [f"kind: x\nprops: {f}\nend: 1" for f in (*FLOWS, *many, repeated)] + ['a:\n  - {"k": 1}', 'a: {"k": 1}\n  - x', 'a: {"k": 1}\na: 2']
    assert [outcome(read_fields, t) for t in texts] == [outcome(read_yaml, t) for t in texts]
    df = spark.createDataFrame([(i, f"---\n{t}\n---\n") for i, t in enumerate(texts)], "n int, t string")
    got = dict(df.select("n", invalid(F.col("t"))).collect())
    assert [got[i] for i in range(len(texts))] == [outcome(read_yaml, t) == "invalid" for t in texts]
    plain = dict(df.select("n", F.regexp_extract("t", frontmatter._JVM_PLAIN, 0) != "").collect())
    assert all(plain[i] for i in range(SHORT))
    monkeypatch.setattr(frontmatter, "read_yaml", None)
    for text in texts[:SHORT]:
        read_fields(text)
