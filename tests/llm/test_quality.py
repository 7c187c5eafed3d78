import math
import random

import zstandard

from notegraph.llm import quality, queries


def labelled(spark, prose, n=300):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 2
        rows.append((i, prose(120, i) if good else " ".join(f"BUY!! {r.choice(['NOW', 'CHEAP', 'WIN'])}$$ {r.randint(0, 99)}" for _ in range(60))))
        labels.append((i, good))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")


def test_good_and_bad_texts(spark, prose):
    docs, labels = labelled(spark, prose)
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, prose(60_000, 77), 0.0), (4, "BUY!! NOW$$ 3 " * 40, 0.0), (4, "BUY!! NOW$$ 3 " * 40, 0.0), (5, "日本", 0.0)], "doc_id long, text string, score double")
    got = [tuple(r) for r in odd.select("doc_id", quality.score(model, odd).alias("score")).collect()]
    by = dict(got)
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got)
    assert by[1] == by[2] == model.base and by[3] > 0.8 and by[4] < 0.2
    assert spark.createDataFrame([], odd.schema).select(quality.score(model, odd).alias("score")).collect() == []


def test_fitting_is_deterministic(spark, prose):
    docs, labels = labelled(spark, prose, 120)
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(7), labels.repartition(3))
    assert a.dictionaries == b.dictionaries and (a.beta == b.beta).all()


def test_too_few_labels(spark, prose):
    docs, labels = labelled(spark, prose, 40)
    empty = quality.fit(docs, labels.filter("label > 5"))
    assert docs.select(quality.score(empty, docs).alias("s")).distinct().collect()[0]["s"] == 0.5
    one = quality.fit(docs, labels.filter("label = 1"))
    assert not one.usable
    few = quality.fit(docs, labels.filter("doc_id < 8"))
    assert all(0 <= r["s"] <= 1 for r in docs.select(quality.score(few, docs).alias("s")).collect())


def brute_score(model, text):
    """Window by window with a new compressor each, and the calibration written out."""
    raw = (text or "").encode()
    if not raw:
        return model.base
    size = lambda dictionary: sum(len((zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))).compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
    plain, good, bad = size(None), *map(size, model.dictionaries)
    z = model.beta[0]
    for k, x in enumerate(((bad - good) / plain, plain / len(raw))):
        z += model.beta[k + 1] * max(-4, min(4, (x - model.mean[k]) / model.scale[k]))
    return 1 / (1 + math.exp(-z))


def test_scores_against_brute_force(spark, prose):
    docs, labels = labelled(spark, prose)
    model = quality.fit(docs, labels)
    odd = docs.limit(60).union(spark.createDataFrame([(900, None), (901, ""), (902, "é" * 3000), (903, prose(3000))], docs.schema))
    got = odd.select("text", quality.score(model, odd).alias("score")).collect()
    assert all(abs(r["score"] - brute_score(model, r["text"])) < 0.02 for r in got), [(r["text"][:30], r["score"], brute_score(model, r["text"])) for r in got]


def test_what_reaches_the_driver_is_bounded(spark, prose, monkeypatch):
    """Long texts and repeated ids: at most so many windows and rows are gathered."""
    monkeypatch.setattr(quality, "TRAIN_WINDOWS", 50)
    monkeypatch.setattr(quality, "CALIBRATION_ROWS", 30)
    gathered = []
    train, calibrate = quality.QualityModel.train, quality.QualityModel.calibrate
    monkeypatch.setattr(quality.QualityModel, "train", staticmethod(lambda samples: gathered.append(samples) or train(samples)))
    monkeypatch.setattr(quality.QualityModel, "calibrate", lambda self, x, y: gathered.append(x) or calibrate(self, x, y))
    docs, labels = labelled(spark, prose, 200)
    many = docs.union(spark.createDataFrame([(i % 4, prose(5000, i)) for i in range(40)], docs.schema))
    model = quality.fit(many, labels.union(labels))
    assert [len(x) for x in gathered] == [50, 50, 30] and max(map(len, gathered[0] + gathered[1])) <= quality.WINDOW
    assert model.usable


def test_held_out_separation(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in queries.op6_quality(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    pairs = [(g > b) + (g == b) / 2 for g in good for b in bad]
    assert sum(pairs) >= 0.75 * len(pairs)
