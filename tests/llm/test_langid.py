import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notegraph.llm import langid, queries


def test_codebooks_keep_words_apart():
    for n in (2, 3, 4, 7, 8, 30):
        code = langid.codebook(n)
        distance = (code.shape[1] - code @ code.T) / 2
        assert code.shape[0] == n and (distance + np.eye(n) * 99).min() >= (1 if n == 2 else 2)
        assert all(len(set(column)) == 2 for column in code.T)  # no bit is the same for all


def test_trigrams_of_pieces_are_those_of_the_text(monkeypatch):
    text = "Ein längerer Text, in Stücken gelesen." * 20
    whole = [langid.trigram_ids(d) for _, d in langid.pieces(pa.array([text]))]
    monkeypatch.setattr(langid, "PIECE", 64)
    parts = [langid.trigram_ids(d) for _, d in langid.pieces(pa.array([text]))]
    assert len(parts) > 5 and np.array_equal(np.concatenate(parts), np.concatenate(whole))


def test_a_flipped_bit_is_corrected():
    model = langid.LanguageModel(list("abcd"), np.random.default_rng(0).integers(0, 50, (4, langid.FEATURES)))
    model.bit_weights = np.ones(7) / 7
    for i, word in enumerate(model.code):
        for b in range(7):
            heard = word.copy()
            heard[b] = -heard[b]
            assert model.decode(heard[None])[0][0] == i
    assert model.decode(np.zeros((1, 7)))[2][0]  # no evidence: ambiguous


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def test_odd_texts(spark, model, prose):
    rows = [(1, None), (2, ""), (3, "12 $% \n"), (4, "the and of to in that the this with " * 4000), (5, "日本"), (5, "日本"), (6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("s"))
    got = [(r["doc_id"], r["p"]) for r in df.select("doc_id", langid.predict(model, df).alias("p")).collect()]
    assert [p["lang_pred"] for i, p in got if i < 4] == ["und"] * 3 and all(p["score"] == 0 for i, p in got if i < 4)
    assert dict(got)[4]["lang_pred"] == "en" and dict(got)[4]["score"] > 0.9
    assert len(got) == len(rows) and all(0 <= p["score"] <= 1 for _, p in got)


def test_empty_tables(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = langid.fit(empty)
    docs = spark.createDataFrame([(1, "some text", None)], empty.schema)
    assert docs.select(langid.predict(nothing, docs).alias("p")).first()["p"]["lang_pred"] == "und"
    assert empty.select(langid.predict(model, empty).alias("p")).collect() == []
    alone = langid.fit(spark.createDataFrame([(1, "some text", "en"), (2, "x", None)], empty.schema))
    assert alone.languages == ["en"] and docs.select(langid.predict(alone, docs).alias("p")).first()["p"]["lang_pred"] == "en"


def brute_predict(model, text):
    """Trigram by trigram and bit by bit, in plain Python."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    data = [b | 32 if 65 <= (b & ~32) <= 90 and b < 128 else 32 if b < 128 else b for b in f" {text} ".encode()]
    total, n = [0.0] * model.code.shape[1], len(data) - 2
    for x, y, z in zip(data, data[1:], data[2:]):
        mixed = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) & 0xFFFFFFFF
        feature = ((mixed ^ mixed >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16
        for b in range(len(total)):
            total[b] += float(model.weights[feature][b])
    losses = []
    for word in model.code:
        losses.append(len(total) * sum(w * math.log1p(math.exp(-model.gain * c * t / n)) for w, c, t in zip(model.bit_weights, word, total)))
    likely = [math.exp(min(losses) - x) for x in losses]
    return model.languages[losses.index(min(losses))], max(likely) / sum(likely)


def test_prediction_against_brute_force(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000")
    got = {r["doc_id"]: (r["text"], r["p"]) for r in docs.select("doc_id", "text", langid.predict(model, docs).alias("p")).collect()}
    for text, p in got.values():
        lang, score = brute_predict(model, text)
        assert p["lang_pred"] == lang and abs(p["score"] - score) < 1e-6


def test_bit_weights_are_measured_outside_the_profiles(spark, prose):
    """A bit that fails on new texts loses weight; the profiles themselves would not show it."""
    model = langid.LanguageModel(list("abcd"), np.random.default_rng(0).integers(0, 50, (4, langid.FEATURES)))
    seen, right = np.array([100, 100, 100, 0]), np.full((4, 7), 99)
    right[:, 2], right[:, 5], right[3] = 50, 75, 0
    model.weigh(right, seen)
    w = model.bit_weights
    assert w.sum() == pytest.approx(1) and w[2] < 0.01 * w[0] and w[2] < w[5] < w[0] == w[1]
    fitted = langid.fit(spark.createDataFrame([(i, prose(30, i) if i % 2 else prose(30, i).upper()[::-1], "ab"[i % 2]) for i in range(80)], "doc_id long, text string, lang string"))
    assert fitted.languages == ["a", "b"] and fitted.bit_weights.tolist() == [1.0]


def test_held_out_accuracy(spark, sf_dir):
    got = queries.op4_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
