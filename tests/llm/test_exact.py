import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notegraph.llm import exact, queries

DOCS = "doc_id long, text string"


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.sampled_from([0, 1, 12, 40, 63]))
def test_golomb_codes_read_back(values, drop):
    values = np.unique(np.array(sorted(values), np.uint64) >> np.uint64(drop))
    k, code = exact.golomb_encode(values, 64 - drop)
    assert np.array_equal(exact.golomb_decode(len(values), k, code), values)
    if len(values) > 100 and drop == 0:
        assert len(code) < 8 * len(values)


def brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        text = text or ""
        groups.setdefault(text.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))), []).append((-len(text), doc is None, doc or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [(rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return out


def run(spark, rows, owners=3, partitions=4):
    df = spark.createDataFrame(rows, DOCS).repartition(partitions)
    return exact.exact_duplicates(df, owners).collect()


key = lambda rows: sorted(map(repr, rows))


def test_against_brute_force(spark, prose):
    r = random.Random(1)
    base = [prose(5, s) for s in range(40)] + ["", " \n", "é\u00a0x", "é x", prose(40_000, 3)]
    rows = [(i, r.choice(base).replace(" ", r.choice([" ", "\n\n", "\t"]))) for i in range(500)]
    rows += [(1000 + i, "hot  text") for i in range(400)] + [(2000, None), (2001, "   "), (None, "hot text "), (None, "lone")]
    got = run(spark, rows)
    assert key((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"]) for g in got) == key(brute(rows))
    kept = [g for g in got if g["kept"]]
    assert len(kept) == len({g["text_sha256"] for g in got}) and all(g["doc_id"] == g["keep_id"] for g in kept)


def test_repeated_rows_leave_one(spark):
    got = run(spark, [(1, "a b"), (1, "a b"), (1, "a b"), (2, "ab"), (3, "c"), (3, "other")])
    assert sorted((g["doc_id"], g["kept"]) for g in got if g["group_size"] == 4) == [(1, False), (1, False), (1, True), (2, False)]
    assert sorted((g["doc_id"], g["keep_id"], g["group_size"], g["kept"]) for g in got if g["group_size"] == 1) == [(3, 3, 1, True), (3, 3, 1, True)]


def test_small_blocks_and_one_owner(spark, monkeypatch):
    rows = [(i, f"t{i % 37}") for i in range(300)]
    assert key((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"]) for g in run(spark, rows, owners=1, partitions=1)) == key(brute(rows))


def test_empty_and_clashing_columns(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], DOCS + ", sha int, block string")).collect() == []
    df = spark.createDataFrame([(1, "x", 9, "b"), (2, "x ", 9, "b")], DOCS + ", sha int, block string")
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in exact.exact_duplicates(df).collect()) == [(1, 2, False), (2, 2, True)]


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op9_mixing"])
def test_query_and_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    wanted = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(wanted.fetchall())
