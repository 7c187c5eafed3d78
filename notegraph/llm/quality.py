"""Quality classifier by compression.

Two Zstandard dictionaries are trained, one from good and one from bad labelled
texts.  A text's feature is its normalised compressed-size difference, (size with
the bad dictionary - size with the good one) / size without any, beside its plain
compression ratio (a text of repeats fits every dictionary alike); a logistic
calibration on labelled texts that did not enter the dictionaries makes it a score.

Both are fitted on bounded samples, chosen by hashes (documented bounds): about
``per_label`` labelled rows of each label, of which three fifths give at most
``TRAIN_WINDOWS`` windows of ``WINDOW`` bytes for each dictionary and the rest at most
``CALIBRATION_ROWS`` rows of features, measured in the tasks.  Only these windows and
numbers reach the driver, also where texts are very long or ids repeat.  Every whole text
is scored, window by window.

Defined cases: a null text is empty, and an empty text gets the base rate of the
calibration sample; a very long text is judged by the sums over its windows; with no
labelled rows of one kind every score is 0.5; fewer than ``MIN_SAMPLES`` windows, or too
little variety for the trainer, make a dictionary of their own bytes; of windows and rows
with one hash any may be chosen; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, materialise

DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Bytes of a window.  Texts are compressed window by window: in a long stretch a text's own repeats outweigh the dictionaries.
WINDOW = 1 << 10
#: Rows of the bounded sample that train dictionaries; the others calibrate.
TRAIN_PARTS, PARTS = 3, 5
MIN_SAMPLES = 8
#: Windows that train a dictionary, and rows that calibrate: at most 6 MB and 100 KB on the driver.
TRAIN_WINDOWS, CALIBRATION_ROWS = 6_000, 4_000


def compressed_sizes(text: bytes, tools: list[zstandard.ZstdCompressor]) -> list[int]:
    """Summed over all windows of a text, so that a long one is judged like its parts."""
    windows = [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)]
    return [sum(len(c.compress(w)) for w in windows) for c in tools]


class QualityModel:
    """Two dictionaries and the calibration; small, and broadcast to the tasks."""

    def __init__(self, good: list[bytes], bad: list[bytes]):
        self.dictionaries = [self.train(x) for x in (good, bad)]
        self.mean, self.scale, self.beta, self.base = np.zeros(2), np.ones(2), np.zeros(3), 0.5

    @staticmethod
    def train(samples: list[bytes]) -> bytes | None:
        samples = [x for x in samples if x]
        if len(samples) < MIN_SAMPLES:
            return b" ".join(samples)[-DICTIONARY_BYTES:] or None
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too little variety for the trainer: their own bytes
            return b" ".join(samples)[-DICTIONARY_BYTES:]

    def tools(self) -> list[zstandard.ZstdCompressor]:
        dictionaries = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries]
        for d in dictionaries:
            d.precompute_compress(level=LEVEL)
        return [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)] + [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False) for d in dictionaries]

    @property
    def usable(self) -> bool:
        return all(self.dictionaries)

    def features(self, texts: list[bytes | None], tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
        rows = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            if text:
                plain, good, bad = compressed_sizes(text, tools)
                rows[i] = (bad - good) / plain, plain / len(text)
        return rows

    def design(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, no further out than the sample's, with a constant."""
        return np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.scale, -4, 4)]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of labels on features by Newton steps with a small ridge."""
        if not len(y):
            return
        self.base = float((y.sum() + 1) / (len(y) + 2))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        x, beta = self.design(x), np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            beta += np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + 1e-2 * np.eye(3), x.T @ (y - p) - 1e-2 * beta)
        self.beta = beta

    def score(self, texts: list[bytes | None], tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.design(self.features(texts, tools)) @ self.beta, -30, 30)))
        return np.where([bool(t) for t in texts], p, self.base)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2000) -> QualityModel:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, label 0 or 1) mark.

    The sample is drawn from the labels, before any text is read; its ids (about twice
    ``per_label``, whatever the size of the tables) are broadcast.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    chosen = bounded_sample(labels.filter(F.col("label").isin(0, 1)), "label", per_label).select("doc_id", "label").distinct()
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).alias("part")).orderBy(F.xxhash64("chosen_id", F.lit("row")), "label").limit(4 * per_label)
    sample = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), "label", "part")
    sample = materialise(sample, "quality-sample")  # by the scan's tasks; those without a row write no file

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_py()
                cut = [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array([label] * len(cut), pa.int32())], ["bytes", "label"])

    cut = sample.filter(F.col("part") < TRAIN_PARTS).select("text", "label").mapInArrow(windows, "bytes binary, label int")
    rank = F.xxhash64("bytes", F.lit("window"))
    training = [sorted(bytes(r[0]) for r in cut.filter(F.col("label") == k).orderBy(rank, "bytes").limit(TRAIN_WINDOWS).select("bytes").collect()) for k in (1, 0)]
    model = QualityModel(*training)
    if model.usable:
        shared = spark.sparkContext.broadcast(model)

        @F.arrow_udf("difference double, ratio double")
        def features(texts: pa.Array) -> pa.Array:
            m = shared.value
            x = m.features(texts.to_pylist(), m.tools())
            return pa.StructArray.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["difference", "ratio"])

        rest = sample.filter(F.col("part") >= TRAIN_PARTS).select("label", F.xxhash64("text", F.lit("row")).alias("rank"), features.asNondeterministic()(F.col("text")).alias("x"))
        rows = rest.select("rank", "label", "x.difference", "x.ratio").orderBy("rank", "label").limit(CALIBRATION_ROWS).collect()
        model.calibrate(np.array([[r["difference"], r["ratio"]] for r in rows]).reshape(-1, 2), np.array([r["label"] for r in rows], float))
    return model


def score(model: QualityModel, docs: DataFrame, text: str = "text") -> Column:
    """A double column: the calibrated score of the column ``text``."""
    if not model.usable:
        return F.lit(0.5)
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array(m.score(texts.cast(pa.binary()).to_pylist(), m.tools()))

    return quality.asNondeterministic()(F.col(text))
