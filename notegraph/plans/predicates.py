"""The predicate language: ``FIELD OP VALUE`` terms, ``||`` inside a clause, clauses AND-ed.

Word operators are looked for before symbols, in table order and anywhere in the text;
there is no quoting.  Comparisons are numeric if both sides are numbers and bytewise on
the display text otherwise; null and absent fields fail every comparison, and the
negated word operators negate that answer too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidPredicate, RegexError
from ..functions.values import WHITE_SPACE, parse_number
from .values import Value

# Fixed order of the operator search: (text, operator, negated).
WORD_OPERATORS = tuple((f" {'!' * negated}{word}{' ' * (word not in ('exists', 'missing'))}", word, bool(negated)) for word in ("contains", "startswith", "endswith", "matches", "exists", "missing") for negated in (1, 0))
SYMBOLS = (" >= ", " <= ", " != ", " > ", " < ", " = ")


@dataclass(frozen=True)
class Term:
    field: str
    operator: str
    negated: bool = False
    value: str | None = None


def parse_term(text: str) -> Term:
    text = text.strip(WHITE_SPACE)
    for pattern, operator, negated in WORD_OPERATORS:
        if (at := text.find(pattern)) >= 0:
            value = None if operator in ("exists", "missing") else text[at + len(pattern) :].strip(WHITE_SPACE)
            term = Term(_field(text, at), operator, negated, value)
            if operator == "matches":
                java_pattern(value)
            return term
    for pattern in SYMBOLS:
        if (at := text.find(pattern)) >= 0:
            return Term(_field(text, at), pattern.strip(), False, text[at + len(pattern) :].strip(WHITE_SPACE))
    raise InvalidPredicate(f"no operator in: {text}")


def _field(text: str, at: int) -> str:
    field = text[:at].strip(WHITE_SPACE)
    if not field:
        raise InvalidPredicate(f"no field in: {text}")
    return field


def parse_clause(text: str) -> tuple[Term, ...]:
    """The alternatives of one clause."""
    return tuple(parse_term(part) for part in text.split("||"))


def parse_clauses(texts: list[str]) -> list[tuple[Term, ...]]:
    return [parse_clause(t) for t in texts]


def fields_of(clauses: list[tuple[Term, ...]]) -> set[str]:
    return {term.field for clause in clauses for term in clause}


def java_pattern(pattern: str) -> str:
    """A regex of the linear-time dialect (no look-around or back-references, Unicode classes,
    ``$`` only at the very end) for Java's engine."""
    out, in_class, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            if not in_class and (pattern[i + 1].isdigit() and pattern[i + 1] != "0" or pattern[i + 1] == "k"):
                raise RegexError(f"back-reference in: {pattern}")
            out.append("\\z" if pattern[i + 1] == "z" else pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif c == "(" and not in_class:
            if re.match(r"\(\?(=|!|<=|<!|>)", pattern[i:]):
                raise RegexError(f"look-around in: {pattern}")
            if pattern.startswith("(?P<", i):
                out.append("(?<")
                i += 4
                continue
        elif c == "$" and not in_class:
            c = "\\z"
        out.append(c)
        i += 1
    translated = "(?dU)" + "".join(out)
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(translated)
        except Exception as e:
            raise RegexError(f"invalid pattern: {pattern}") from e
    return translated


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


def _numeric(operator: str, number: Column, bound: float, may_be_nan: bool = True) -> Column:
    """Comparison of doubles in which NaN differs from everything."""
    if math.isnan(bound):
        return number.isNotNull() if operator == "!=" else F.lit(False)
    compared = _COMPARE[operator](number, F.lit(bound))
    if not may_be_nan:
        return compared
    return compared | F.isnan(number) if operator == "!=" else compared & ~F.isnan(number)


def _compare(operator: str, value: Value, text: str) -> Column:
    bound = parse_number(text)
    by_text = _COMPARE[operator](value.text if value.native is None or value.static != "string" else value.native, F.lit(text))
    if value.native is not None:  # typed columns: plain comparisons, which reach the file scan
        if value.static in ("integer", "float"):
            if bound is None:
                return value.native.isNotNull() & by_text
            if value.static == "integer" and math.isfinite(bound) and bound == int(bound) and abs(bound) < 1 << 53:
                return _COMPARE[operator](value.native, F.lit(int(bound)))
            return _numeric(operator, value.native, bound, value.static == "float")
        if value.static == "string" and bound is None:
            return by_text
        if value.static != "string":
            return value.native.isNotNull() & by_text
    if bound is None:
        return value.present & by_text
    return value.present & F.when(value.number.isNotNull(), _numeric(operator, value.number, bound)).otherwise(by_text)


def compile_term(term: Term, value: Value) -> Column:
    """A column that is true where the term holds; null means false, except under a negation."""
    if term.operator in ("exists", "missing"):
        held = value.present if (term.operator == "exists") != term.negated else ~value.present
        return held
    text = term.value or ""
    subject = value.native if value.static == "string" else value.text
    if term.operator in _COMPARE:
        return _compare(term.operator, value, text)
    if term.operator == "contains":
        member = F.exists(value.items, lambda x: x["disp"] == text)
        if value.static is not None:
            held = {"list": member, "string": subject.contains(text)}.get(value.static, F.lit(False))
        else:
            held = F.when(value.kind == "list", member).when(value.kind == "string", subject.contains(text)).otherwise(False)
    elif term.operator == "startswith":
        held = value.present & subject.startswith(text)
    elif term.operator == "endswith":
        held = value.present & subject.endswith(text)
    else:
        held = value.present & subject.rlike(java_pattern(text))
    return ~F.coalesce(held, F.lit(False)) if term.negated else held


def compile_clauses(clauses: list[tuple[Term, ...]], resolve: Callable[[str], Value]) -> Column:
    """All clauses hold, each by any of its terms."""
    whole = None
    for clause in clauses:
        either = None
        for term in clause:
            held = compile_term(term, resolve(term.field))
            either = held if either is None else either | held
        whole = either if whole is None else whole & either
    return F.lit(True) if whole is None else whole
