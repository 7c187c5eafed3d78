"""Language identification by error-correcting output codes.

Each language gets a codeword; for each bit a binary classifier on hashed byte
trigrams (naive Bayes: log odds of the languages with a 1 against those with a 0,
each language weighing the same) predicts it.  Decoding takes the codeword with the
least loss, sum over bits of weight x log(1 + exp(-bit x margin)), where a bit's
weight is the log odds of its being right, measured on labelled rows that did not enter
the profiles (each language weighing the same).  A second codeword with nearly the same
loss makes the answer ambiguous.

The classifier is fitted on at most about ``per_language`` rows of each language,
chosen by a hash of the id (a documented bound), of which three quarters make the
profiles and the rest the weights; prediction reads whole texts.

Defined cases: a null, empty or letterless text is ``und`` with score 0; a very long text
is summed piece by piece; of codewords with equal loss the first language by name is
taken, and the answer is ambiguous; without training rows every text is ``und``; null
labels are never learned; repeated rows are learned as often as they stand and judged
alike; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample

FEATURES = 1 << 16
#: Of the sample, one part weighs the bits, the others make the profiles.
PARTS = 4
#: Bytes handled at once; longer texts are summed piece by piece, with an overlap of two bytes.
PIECE = 1 << 20

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
for _c in range(97, 123):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def trigram_ids(data: np.ndarray) -> np.ndarray:
    """Hashed ids of all byte trigrams; letters are folded, other ASCII counts as space."""
    b = _FOLD[data]
    mixed = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bytes) of each text, padded with a space on both sides, in pieces of bounded size."""
    for row, text in enumerate(texts.cast(pa.binary())):
        if (raw := text.as_py()) is not None:
            data = np.frombuffer(b" " + raw + b" ", np.uint8)
            for at in range(0, max(1, len(data) - 2), PIECE):
                yield row, data[at : at + PIECE + 2]


def codebook(n: int) -> np.ndarray:
    """+1/-1 codewords, one row for each of ``n`` languages, all columns distinct splits.

    Up to 7 languages: every split (exhaustive code).  More: the best of 200 seeded
    random codes of 15 bits for each doubling, by the least distance of two codewords.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c], dtype=float).T
    rng, best, least = np.random.default_rng(7), None, -1
    width = 15 * int(np.ceil(np.log2(n)))
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, width))
        gap = ((width - code @ code.T) / 2 + np.eye(n) * width).min()
        if gap > least and (np.abs(code.sum(0)) < n).all():
            best, least = code, gap
    return best


class LanguageModel:
    """Bit classifiers, codebook and bit weights; small, and broadcast to the tasks."""

    def __init__(self, languages: list[str], counts: np.ndarray, gain: float = 6.0):
        self.languages, self.code, self.gain = languages, codebook(len(languages)), gain
        profile = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        ones, zeros = self.code > 0, self.code <= 0
        mean = lambda pick: np.stack([profile[pick[:, b]].mean(0) if pick[:, b].any() else np.full(counts.shape[1], 1 / counts.shape[1]) for b in range(self.code.shape[1])])
        self.weights = (np.log(mean(ones)) - np.log(mean(zeros))).T.astype(np.float32)
        self.bit_weights = np.full(self.code.shape[1], 1 / self.code.shape[1])

    def weigh(self, right: np.ndarray, seen: np.ndarray) -> None:
        """Bit weights from right answers (languages x bits) on ``seen`` texts of each language outside the profiles."""
        if seen.sum():
            rate = ((right + 1) / (seen + 2)[:, None])[seen > 0].mean(0)
            odds = np.log(rate / (1 - rate))
            floor = 1e-3 * max(odds.max(), 1e-3)  # a bit that is wrong as often as right says nothing
            self.bit_weights = np.maximum(odds, floor) / np.maximum(odds, floor).sum()

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Mean log odds of each bit for each text."""
        total, n = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for row, data in pieces(texts):
            if len(data) > 2:
                ids = trigram_ids(data)
                seen = np.bincount(ids) if len(ids) > 8 * FEATURES else None
                total[row] += self.weights[ids].sum(0, dtype=np.float64) if seen is None else seen @ self.weights[: len(seen)]
                n[row] += len(ids)
        return total / np.maximum(n, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score, ambiguous) of each row."""
        z = self.gain * margins
        loss = np.stack([(np.logaddexp(0, -z * word) * self.bit_weights).sum(1) for word in self.code], 1) * self.code.shape[1]
        likely = np.exp(loss.min(1, keepdims=True) - loss)
        likely /= likely.sum(1, keepdims=True)
        ranked = np.sort(likely, 1)
        second = ranked[:, -2] if loss.shape[1] > 1 else np.zeros(len(loss))
        return loss.argmin(1), ranked[:, -1], ranked[:, -1] - second < 0.2


def fit(train: DataFrame, per_language: int = 3000) -> LanguageModel:
    """Fit on ``train`` (doc_id, text, lang).

    Trigram counts and right answers are summed by Spark; at most languages x FEATURES sums reach the driver.
    """
    bound_batches(train.sparkSession)
    rows = bounded_sample(train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), "lang", per_language)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for row, data in pieces(batch.column(1)):
                if len(data) > 2:
                    sums.setdefault(langs[row], np.zeros(FEATURES, np.int64))
                    sums[langs[row]] += np.bincount(trigram_ids(data), minlength=FEATURES)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "feature", "n"])

    sums = rows.filter(part < PARTS - 1).select("lang", "text").mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    languages = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(languages), FEATURES))
    if languages:
        index = {x: i for i, x in enumerate(languages)}
        counts[[index[x] for x in got.column("lang").to_pylist()], got.column("feature").to_numpy()] = got.column("n").to_numpy()
    model = LanguageModel(languages, counts)
    if len(languages) < 2:
        return model
    shared = train.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, right, seen = shared.value, np.zeros(shared.value.code.shape, np.int64), np.zeros(len(languages), np.int64)
        for batch in batches:
            at = np.array([index.get(x, -1) for x in batch.column(0).to_pylist()])
            hits = (np.sign(m.margins(batch.column(1))) == m.code[at])[at >= 0]
            np.add.at(right, at[at >= 0], hits)
            np.add.at(seen, at[at >= 0], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(languages)), pa.int32()), pa.array(seen), pa.array(right.tolist(), pa.list_(pa.int64()))], ["language", "seen", "right"])

    judged = rows.filter(part == PARTS - 1).select("lang", "text").mapInArrow(judge, "language int, seen long, right array<long>")
    summed = judged.select("language", "seen", F.posexplode("right").alias("bit", "n")).groupBy("language", "bit").agg(F.sum("seen").alias("seen"), F.sum("n").alias("n")).collect()
    right, seen = np.zeros(model.code.shape), np.zeros(len(languages))
    for r in summed:
        right[r["language"], r["bit"]], seen[r["language"]] = r["n"], r["seen"]
    model.weigh(right, seen)
    return model


def predict(model: LanguageModel, docs: DataFrame, text: str = "text") -> Column:
    """A struct column lang_pred, score, ambiguous for the column ``text``."""
    if not model.languages:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def identify(texts: pa.Array) -> pa.Array:
        m = shared.value
        best, score, ambiguous = m.decode(m.margins(texts))
        return pa.StructArray.from_arrays([pa.array([m.languages[i] for i in best], pa.string()), pa.array(score), pa.array(ambiguous)], ["lang_pred", "score", "ambiguous"])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    # Non-deterministic for the optimiser only: else a filter on the answer would compute it twice.
    return F.when(letters, identify.asNondeterministic()(F.col(text))).otherwise(none)
