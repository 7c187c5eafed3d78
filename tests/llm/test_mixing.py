import hashlib
import math
import re

import pytest

from notegraph.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, source string, text string, block string, cut int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "b", 1) for r in rows], DOCS).repartition(4)


def rows_of(sizes):
    out, n = [], 0
    for source, count, words in sizes:
        for _ in range(count):
            out.append((n, source, " ".join(["w"] * (words + n % 3))))
            n += 1
    return out


def key(block, doc):
    return hashlib.md5(f"mix:{block}:{'' if doc is None else doc}".encode()).hexdigest()


def brute(rows, mix):
    tokens = {}
    for _, s, t in rows:
        tokens[s] = tokens.get(s, 0) + len(WORD.findall(t or ""))
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())
    budget = mix.budget if mix.budget is not None else total
    share = {s: n / total for s, n in tokens.items()}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    def holds(a):
        w = weights(a)
        if mix.entropy is not None:
            return -sum(x * math.log(x) for x in w.values()) >= mix.entropy * math.log(len(w))
        return max(w[s] * budget / tokens[s] for s in w) > mix.repetition

    low, width = 0.0, 1.0
    if holds(1.0):
        low = 1.0
    else:
        for _ in range(24):
            width /= 2
            low += width if holds(low + width) else 0
        if mix.entropy is None:
            low += width
    out = []
    for s, w in weights(low).items():
        left = round(w * budget)
        members = [(d, len(WORD.findall(t or ""))) for d, x, t in rows if x == s]
        for block in range(left // tokens[s]):
            out += [(d, s, n, block) for d, n in members]
        block, left, used = left // tokens[s], left % tokens[s], 0
        ordered = sorted(members, key=lambda m: key(block, m[0]))
        while ordered:
            peers = [m for m in ordered if m[0] == ordered[0][0]]
            if used + sum(n for _, n in peers) > left:
                break
            used += sum(n for _, n in peers)
            out += [(d, s, n, block) for d, n in peers]
            ordered = ordered[len(peers) :]
    return out, weights(low)


CASES = rows_of([("big", 700, 8), ("mid", 60, 10), ("small", 15, 20), (None, 9, 5), ("blank", 4, -9)])
CASES += [(5000, "mid", None), (5001, "mid", ""), (5001, "mid", ""), (5002, "small", "x " * 400), (None, "small", "a b c"), (5003, "big", "twin é z"), (5003, "big", "twin é z")]


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(entropy=0.7), mixing.Mix(entropy=0.1), mixing.Mix(entropy=0.9, budget=2000), mixing.Mix(entropy=None, repetition=3.0), mixing.Mix(entropy=None, repetition=1.5, budget=9000), mixing.Mix(entropy=None, repetition=50.0)])
def test_against_brute_force(spark, mix):
    got = mixing.mix_sources(docs(spark, CASES), mix).collect()
    wanted, weights = brute(CASES, mix)
    assert sorted(((r["doc_id"], r["source"], r["n_tokens"], r["block"]) for r in got), key=repr) == sorted(wanted, key=repr)
    assert all(r["order_key"] == key(r["block"], r["doc_id"]) for r in got)
    if mix.entropy == 0.7:
        assert abs(-sum(w * math.log(w) for w in weights.values()) / math.log(len(weights)) - 0.7) < 1e-4
    if mix.repetition == 3.0:
        assert max(r["block"] for r in got) <= 3


def test_very_long_texts_and_ties(spark):
    """A text longer than its source's budget counts whole; rows with one key go together."""
    rows = rows_of([("big", 300, 8), ("small", 30, 20)]) + [(9000, "big", "word\t" * 300_000), (9001, "long", "é\n" * 200_000), (9002, "small", "w " * 50), (9002, "small", "w " * 70)]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    wanted, _ = brute(rows, mixing.Mix())
    assert sorted(((r["doc_id"], r["source"], r["n_tokens"], r["block"]) for r in got), key=repr) == sorted(wanted, key=repr)


def test_documents_keep_their_columns(spark):
    df = docs(spark, CASES)
    mixed = mixing.mixed_documents(df)
    assert mixed.dtypes == df.dtypes
    taken = mixing.mix_sources(df)
    assert sorted(map(repr, (r["doc_id"] for r in mixed.select("doc_id").collect()))) == sorted(map(repr, (r["doc_id"] for r in taken.collect())))


def test_empty_and_wordless_tables(spark):
    assert mixing.mix_sources(docs(spark, [])).collect() == []
    assert mixing.mix_sources(docs(spark, [(1, "a", None), (2, "b", "  ")])).collect() == []
    assert len(mixing.mix_sources(docs(spark, [(1, "a", "x y")])).collect()) == 1


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_sources(docs(spark, CASES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
