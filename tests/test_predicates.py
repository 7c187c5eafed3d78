"""The predicate language: parsing, and its meaning against a row-at-a-time evaluation."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notegraph.errors import InvalidPredicate, RegexError
from notegraph.functions.values import FIELDS, display, parse_number, to_cell, to_number, type_name
from notegraph.operators.records import Records, from_table
from notegraph.plans.fields import NoteFields
from notegraph.plans.predicates import Term, java_pattern, parse_clause, parse_term


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("status = to-watch", Term("status", "=", False, "to-watch")),
        ("tags contains topic/x", Term("tags", "contains", False, "topic/x")),
        ("tags !contains topic/x", Term("tags", "contains", True, "topic/x")),
        ("hsk >= 2", Term("hsk", ">=", False, "2")),
        ("rating exists", Term("rating", "exists", False, None)),
        ("rating !missing", Term("rating", "missing", True, None)),
        ("  year <= 2020 ", Term("year", "<=", False, "2020")),
        ("title = x contains y", Term("title = x", "contains", False, "y")),  # word operators come first
        ("note = it existsnow", Term("note = it", "exists", False, None)),
        ("a != b = c", Term("a", "!=", False, "b = c")),
    ],
)
def test_parse(text, wanted):
    assert parse_term(text) == wanted


@pytest.mark.parametrize("text", ["no operator here", " = value", "status = ", "contains x", ""])
def test_parse_errors(text):
    with pytest.raises(InvalidPredicate):
        parse_term(text)


def test_alternatives_are_split_first():
    assert [t.value for t in parse_clause("a = 1 || a = 2")] == ["1", "2"]
    with pytest.raises(InvalidPredicate):
        parse_clause("a matches x||y")


def test_patterns(spark):
    assert java_pattern("^a$") == "(?dU)^a\\z" and java_pattern(r"[$]\$") == r"(?dU)[$]\$" and java_pattern("(?P<n>x)") == "(?dU)(?<n>x)"
    for bad in ("(?=x)", "(?<!x)", r"(a)\1", "(", "[a"):
        with pytest.raises(RegexError):
            java_pattern(bad)


def holds(term: Term, value, present: bool) -> bool:
    """One term on one value, as the language defines it."""
    there = present and value is not None
    if term.operator in ("exists", "missing"):
        result = there == (term.operator == "exists")
        return not result if term.negated else result
    result = False
    if there:
        text, rhs = display(value), term.value
        if term.operator == "contains":
            result = any(display(x) == rhs for x in value) if isinstance(value, list) else isinstance(value, str) and rhs in value
        elif term.operator == "startswith":
            result = text.startswith(rhs)
        elif term.operator == "endswith":
            result = text.endswith(rhs)
        else:
            a, b = to_number(value), parse_number(rhs)
            if a is None or b is None:
                a, b = text.encode(), rhs.encode()
            result = {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[term.operator]
    return not result if term.negated else result


values = st.one_of(
    st.none(),
    st.sampled_from(["007", "7", "abc", "", "nan", "NaN", "inf", "1e2", "1d", "é", "10", "9", "true", "a, b"]),
    st.integers(-20, 120),
    st.sampled_from([7.0, 0.5, math.nan, math.inf, 1e21, -0.0]),
    st.booleans(),
    st.lists(st.sampled_from(["a", "b", 7, None, True]), max_size=3),
    st.dictionaries(st.sampled_from("ab"), st.integers(0, 3), max_size=2),
)
terms = st.builds(
    Term,
    st.sampled_from(["f", "g"]),
    st.sampled_from(["=", "!=", ">", "<", ">=", "<=", "contains", "startswith", "endswith", "exists", "missing"]),
    st.just(False),
    st.sampled_from(["7", "007", "7.0", "abc", "a", "nan", "inf", "100", "é", "10", "true", "b"]),
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from("fg"), values), min_size=1, max_size=12), st.lists(st.tuples(terms, st.booleans()), min_size=6, max_size=12))
def test_meaning(spark, rows, asked):
    from notegraph.plans.predicates import compile_term

    asked = [Term(t.field, t.operator, neg and t.operator not in ("=", "!=", ">", "<", ">=", "<="), None if t.operator in ("exists", "missing") else t.value) for t, neg in asked]
    cells = [(i, {k: to_cell(v) for k, v in r.items()}) for i, r in enumerate(rows)]
    df = spark.createDataFrame(cells, f"i int, fields {FIELDS}")
    resolve = NoteFields(df)
    got = df.select("i", *[F.coalesce(compile_term(t, resolve(t.field)), F.lit(False)).alias(f"t{n}") for n, t in enumerate(asked)]).orderBy("i").collect()
    for row, out in zip(rows, got):
        for n, t in enumerate(asked):
            assert out[f"t{n}"] == holds(t, row.get(t.field), t.field in row), (row, t)


def test_typed_columns_mean_the_same(spark):
    df = spark.createDataFrame([(1, "007", 7, 0.5, True), (2, "nan", None, float("nan"), False), (3, "abc", 10, 8.0, None), (4, None, 9, 1e21, True)], "i int, s string, n long, d double, b boolean")
    ids = lambda *w: [r[0] for r in from_table(df, order=["i"]).where(*w).sorted().select("i").collect()]
    assert ids("s = 7") == [1] and ids("s != 7") == [2, 3] and ids("s = NaN") == [] and ids("s > aa") == [2, 3]
    assert ids("n > 9") == [3] and ids("n startswith 1") == [3] and ids("n missing") == [2] and ids("n !contains 1") == [1, 2, 3, 4]
    assert ids("d = 8") == [3] and ids("d endswith 0000") == [4] and ids("d != 8") == [1, 2, 4] and ids("d = nan") == []
    assert ids("b = true") == [1, 4] and ids("b = 1") == [] and ids("nothing exists") == [] and ids("nothing missing") == [1, 2, 3, 4]
    assert ids("n < 10 || b missing", "i > 1") == [3, 4]


def test_sort_order_is_total(spark):
    rows = [(0, {}), (1, {"f": None}), (2, {"f": 9}), (3, {"f": "10"}), (4, {"f": "1a"}), (5, {"f": "abc"}), (6, {"f": 9.0}), (7, {})]
    df = spark.createDataFrame([(i, ["x", f"{i}"], {k: to_cell(v) for k, v in f.items()}) for i, f in rows], f"i int, path_key array<string>, fields {FIELDS}")
    records = Records(df, NoteFields(df), ("path_key",))
    up = [r["i"] for r in records.sorted("f").df.collect()]
    assert up == [0, 7, 1, 2, 6, 3, 4, 5]
    assert [r["i"] for r in records.sorted("f", descending=True).df.collect()] == up[::-1]
    assert [r["i"] for r in records.sorted("f", limit=3).df.collect()] == up[:3]
    assert type_name({}) == "map"
