"""Secret scan: fixed patterns plus a battery of randomness tests.

Patterns (kinds ``assign``, ``access``, ``hex``) give the base spans.  The method adds
spans of kind ``random``: each run of 20 or more token characters is split at ``=``
(padding at the end of a run stays with its last part), and a part that mixes ``+`` or
``/`` with ``-`` or ``_``, which no alphabet holds together, once at the former and once
at the latter.  Each part of 20 or more characters is a candidate, also where two of them
overlap (then both can be reported).  A part with ``/`` has two readings, as it is and
cut at ``/`` like a path; the likelier one counts, and pays for the choice by twice its p.

A candidate's encoding is inferred (the smallest alphabet that holds it) and a battery of
three tests asks whether it looks uniform over that alphabet: chi-squared of the symbol
counts, runs above and below the middle, and lag-1 serial correlation; Fisher's method
combines their p-values.  Against ordinary text stands the tail of the log likelihood
ratio for its length: uniform against the characters of its own document, with a fixed
prior and a share of stray characters that are alike.  The p-value of a candidate is that tail divided by the battery's p-value, 1 at
most: never less than the tail, so still valid for ordinary text, near it for random
strings, and 1 for what is neither.  In each length class a Benjamini-Hochberg bound on
these p-values over *all* candidates of the table then controls the share of false finds;
the bound comes from a histogram of fixed size.

Offsets are code points, ends exclusive.  Defined cases: a null text is empty and has
no spans; a very long text is scanned whole, in time linear in its length; candidates
that touch a base span are left out; spans that start together go by kind and then end;
candidates with one p-value are all found or none; repeated rows get the same spans (and
each counts as a candidate); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
PART, NO_PATH, NO_WORD, STEP = re.compile(rb"[^=]+"), re.compile(rb"[^+/]+"), re.compile(rb"[^_-]+"), re.compile(rb"[^/]+")
LEAST = 20
#: Lower ends of the length classes.
LENGTHS = (20, 24, 32, 48, 64, 128)
FALSE_DISCOVERY = 0.001
#: Share of an ordinary string's characters that may be any: no rare one (a dash, a capital) alone speaks for chance.
STRAY = 0.3

_LETTERS = b"etaoinsrhldcumfpgwybvkxjqz"  # fixed: letters of European prose, most frequent first
_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (_DIGITS, _DIGITS + b"abcdef", _DIGITS + b"ABCDEF", _LOWER, _UPPER, _UPPER + b"234567", _DIGITS + _LOWER, _DIGITS + _UPPER, _LOWER + _UPPER, _DIGITS + _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS + b"+/", _UPPER + _LOWER + _DIGITS + b"-_")
_SETS = [frozenset(a) for a in ALPHABETS]

_TOKEN = np.zeros(256, bool)
_TOKEN[list(_DIGITS + _LOWER + _UPPER + b"+/_=-")] = True
_PRIOR = np.full(256, 0.05)
for _i, _c in enumerate(_LETTERS):
    _PRIOR[_c], _PRIOR[_c - 32] = 100 / (_i + 3), 3 / (_i + 3)
_PRIOR[list(_DIGITS)] = 0.4


def tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniform_tests(x: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of chi-squared, runs and serial-correlation tests of ``x`` in 0..size-1."""
    n = len(x)
    squares = float((np.bincount(x, minlength=size).astype(float) ** 2).sum())
    chi = (size * squares / n - n - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = x * 2 >= size
    a, b = int(high.sum()), int(n - high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = 2 * tail(abs(runs - mean) / math.sqrt(var))
    else:
        p_runs = 0.0
    centred = x - x.mean()
    spread = float((centred**2).sum())
    p_serial = 2 * tail(abs(float((centred[1:] * centred[:-1]).sum()) / spread) * math.sqrt(n)) if spread else 0.0
    return tail(chi), p_runs, p_serial


def battery(x: np.ndarray, size: int) -> float:
    """The tests' p-values combined by Fisher's method: the tail of chi-squared with 6 degrees of freedom."""
    half = -sum(math.log(max(p, 1e-300)) for p in uniform_tests(x, size))
    return math.exp(-half) * (1 + half + half * half / 2)


def prose_p(x: np.ndarray, alphabet: bytes, text_counts: np.ndarray) -> float:
    """Tail of the log likelihood ratio, uniform against text, under text."""
    at = np.frombuffer(alphabet, np.uint8)
    q = text_counts[at] + 200 * _PRIOR[at] / _PRIOR.sum()
    q = (1 - STRAY) * q / q.sum() + STRAY / len(at)
    ratio = -np.log(len(at) * q)
    mean = float((q * ratio).sum())
    var = float((q * ratio**2).sum()) - mean**2
    if var <= 1e-12:
        return 1.0
    return tail((float(ratio[x].sum()) - len(x) * mean) / math.sqrt(len(x) * var))


def token_runs(data: np.ndarray) -> np.ndarray:
    """(start, end) of each run of at least LEAST token characters."""
    inside = np.concatenate(([False], _TOKEN[data], [False]))
    ends = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    return ends[ends[:, 1] - ends[:, 0] >= LEAST]


def parts(raw: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, end with padding) of each candidate in a run, in order."""
    found, bare = set(), start + len(raw[start:end].rstrip(b"="))
    for m in PART.finditer(raw, start, end):
        mixed = (b"+" in m[0] or b"/" in m[0]) and (b"-" in m[0] or b"_" in m[0])
        for p in itertools.chain(*[split.finditer(raw, m.start(), m.end()) for split in (NO_PATH, NO_WORD)]) if mixed else (m,):
            if p.end() - p.start() >= LEAST:
                found.add((p.start(), p.end(), end if p.end() == bare else p.end()))
    return sorted(found)


def scan_text(raw: bytes) -> tuple[list[tuple], list[tuple]]:
    """Base spans (start, kind rank, end, kind) and candidates (start, end, length, p) in bytes."""
    runs = token_runs(np.frombuffer(raw, np.uint8))
    lower = raw.lower()
    base = []
    if any(h in lower for h in HINTS):
        base += [(m.start(), 0, m.end(), KINDS[0]) for m in ASSIGN.finditer(raw) if len(m[1]) >= 6]
    for start, end in runs.tolist():
        base += [(m.start(), 1, m.end(), KINDS[1]) for m in ACCESS.finditer(raw, start, end) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), KINDS[2]) for m in HEX.finditer(raw, start, end) if len(m[0]) >= 24]
    candidates, counts = [], None
    for start, bare, end in (x for run in runs.tolist() for x in parts(raw, *run)):
        if any(start < b[2] and b[0] < end for b in base):
            continue
        if counts is None:
            counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
            for s, e in runs.tolist():
                counts -= np.bincount(np.frombuffer(raw[s:e], np.uint8), minlength=256)
        whole = (start, end, bare - start, random_p(raw[start:bare], counts))
        steps = [m.span() for m in STEP.finditer(raw, start, bare) if m.end() - m.start() >= LEAST] if b"/" in raw[start:bare] else []
        if not steps:
            candidates.append(whole)
            continue
        cut = [(s, end if e == bare else e, e - s, random_p(raw[s:e], counts)) for s, e in steps]
        chosen = [whole] if whole[3] <= min(c[3] for c in cut) else cut
        candidates += [(s, e, n, min(1.0, 2 * p)) for s, e, n, p in chosen]
    return base, candidates


def random_p(token: bytes, text_counts: np.ndarray) -> float:
    """The candidate's p-value against ordinary text, no less where the battery speaks against chance."""
    symbols = set(token)
    kind = next(i for i, a in enumerate(_SETS) if symbols <= a)
    table = np.zeros(256, np.int64)
    table[np.frombuffer(ALPHABETS[kind], np.uint8)] = np.arange(len(ALPHABETS[kind]))
    x = table[np.frombuffer(token, np.uint8)]
    return min(1.0, prose_p(x, ALPHABETS[kind], text_counts) / max(battery(x, len(ALPHABETS[kind])), 1e-300))


_SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string>"
_FOUND = pa.struct([("base", pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())]))), ("tried", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length_class", pa.int32()), ("tenths", pa.int32())])))])


def _scan(texts: pa.Array) -> pa.Array:
    out = []
    for raw in texts.cast(pa.binary()).to_pylist():
        base, tried = scan_text(raw or b"")
        if (base or tried) and not raw.isascii():
            points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
            base = [(int(points[s]), r, int(points[e]), k) for s, r, e, k in base]
            tried = [(int(points[s]), int(points[e]), n, p) for s, e, n, p in tried]
        out.append(
            {
                "base": [dict(zip(("start", "rank", "end", "kind"), x)) for x in base],
                "tried": [{"start": s, "end": e, "length_class": sum(n >= x for x in LENGTHS) - 1, "tenths": int(min(400, -10 * math.log10(max(p, 1e-40))))} for s, e, n, p in tried],
            }
        )
    return pa.array(out, _FOUND)


def discovery_bounds(tried: DataFrame, level: float = FALSE_DISCOVERY) -> dict[int, int]:
    """For each length class the least -10 log10 p that Benjamini-Hochberg lets through.

    The histogram has at most 6 x 401 cells, however many candidates there are.
    """
    cells = tried.groupBy("length_class", "tenths").count().collect()
    bounds = {}
    for length in {r[0] for r in cells}:
        counts = sorted(((r[1], r[2]) for r in cells if r[0] == length), reverse=True)
        total, found = sum(n for _, n in counts), 0
        for tenths, n in counts:
            found += n
            if 10 ** (-tenths / 10) * total / found <= level:
                bounds[length] = tenths
    return bounds


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and all spans (arrays of start, rank, end, kind, in order) of each row."""
    bound_batches(docs.sparkSession)
    scan = F.arrow_udf(_scan, f"base array<{_SPAN}>, tried array<struct<start: bigint, end: bigint, length_class: int, tenths: int>>").asNondeterministic()
    found = materialise(docs.select("doc_id", scan(F.col("text")).alias("found")).select("doc_id", "found.base", "found.tried"), "secrets")
    bounds = discovery_bounds(found.select(F.explode("tried").alias("x")).select("x.length_class", "x.tenths"))
    passes = F.create_map(*[F.lit(x) for k in range(len(LENGTHS)) for x in (k, bounds.get(k, 1 << 20))])
    added = F.transform(F.filter("tried", lambda c: c["tenths"] >= F.element_at(passes, c["length_class"])), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind")))
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added.cast(f"array<{_SPAN}>"))).alias("spans"))
