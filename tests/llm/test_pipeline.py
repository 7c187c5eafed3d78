"""The pipeline against its stages, each on the input that it had."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from notegraph.llm import simhash
from notegraph.llm.common import table


def test_stages_and_run(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], sf_dir)
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert [k.columns for k in kept[:-1]] == [columns] * 5
    ids = [[r["doc_id"] for r in k.select("doc_id").collect()] for k in kept]
    start, language, deduped, clean, mixed, encoded = ids
    assert len(language) >= 0.99 * len(start)
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(kept[1]).collect()}
    assert sorted(deduped) == sorted(set(prints.values()))
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    dirty = {d for d in deduped if any(x in texts[d] for x in items)}
    assert set(deduped) - set(clean) >= dirty and len(clean) >= len(deduped) - 2 * len(dirty) - 1
    assert set(mixed) <= set(clean) and len(mixed) > 0.8 * len(clean)
    assert sorted(encoded) == sorted(mixed)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r in kept[-1].orderBy("start").collect():
        own = np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept[-1].collect()))


def test_near_dedup_loses_no_text(spark, sf_dir, prose):
    """Whatever the ids, exactly one row of each group of near texts stays, by brute force over the texts."""
    from test_simhash import brute_components, brute_fingerprint

    texts = [prose(60, 700 + i) for i in range(12)]
    rows = [(3, texts[0]), (5, texts[0]), (5, texts[1])] + [(None, t) for t in texts[2:6]] + [(None, texts[2]), (7, texts[6]), (7, texts[7]), (7, texts[6]), (8, texts[8]), (9, texts[8] + " "), (None, None), (None, ""), (10, texts[9]), (4, texts[9])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    group = brute_components([(i, brute_fingerprint(t)) for i, (_, t) in enumerate(rows)])
    of = {}
    for i, row in enumerate(rows):
        of.setdefault(row, group[i])
    assert set(kept) <= set(rows) and sorted(of[k] for k in kept) == sorted(set(group.values()))


def test_odd_input(spark, sf_dir, tmp_path):
    rows = [(i, t, "en", s, 0, "clash") for i, (t, s) in enumerate([(None, "a"), ("", None), ("12 34", "a"), ("the same words are in this text and that", None), ("the same words are in this text and that", "b")])]
    rows += [rows[-1], (None, "and the other one was for it", "en", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _language string")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "token_output":
            assert out.columns == docs.columns
        docs = out if name != "language" else docs.filter(F.col("text").isNotNull())
    assert docs.count() >= 2


def test_empty_input(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() == 0
