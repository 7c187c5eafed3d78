"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Texts are equal when identical after deleting the six ASCII white-space characters.

1. *Senders* (the scan's tasks, in blocks of at most ``BLOCK`` documents) hash each
   normalised text, drop repeats inside the block, sort the 64-bit fingerprints and
   send each owner its hash range as one Golomb-Rice coded difference list.
2. *Owners* merge the lists of all blocks and answer each with a bitmap: which of
   its fingerprints some other block holds too.
3. Senders add the repeats inside their own block; documents marked by either are
   suspects.  Only suspects' texts go on: they are grouped by their bytes.

A fingerprint that a third of all rows share is sent once by each block, and its
texts are combined before the shuffle.  A block's fingerprints, codes and bitmap
fit in a few MB; an owner holds 1/``owners`` of the distinct fingerprints of blocks,
and there are as many owners as the rows need, so that its memory doesn't grow with them.

Defined cases: a null text is empty; all white-space texts are equal; a very long text
is hashed and compared whole; among equal
texts the row with the most code points stays, then the smallest doc_id (null last),
then the first read; repeated rows count as members, and exactly one row of a group
is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise

BLOCK = 1 << 16
#: Rows for each owner at most, so that an owner's fingerprints stay within some tens of MB.
OWNER_ROWS = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def golomb_encode(values: np.ndarray, span_bits: int) -> tuple[int, bytes]:
    """(parameter k, code) of sorted distinct values below 2**span_bits.

    Rice form of a Golomb code: of each difference, the quotient by 2**k in unary
    and the remainder in k bits; the two planes are stored one after the other.
    """
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, span_bits - max(1, len(values)).bit_length())
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rest = np.unpackbits((gaps & np.uint64((1 << k) - 1)).astype(">u8").view(np.uint8)).reshape(-1, 64)[:, 64 - k :]
    return k, np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]  # the n-th one ends the unary plane
    unary_bytes = (int(ends[-1]) + 8) // 8
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    rest = np.zeros((n, 64), np.uint8)
    rest[:, 64 - k :] = bits[unary_bytes * 8 : unary_bytes * 8 + n * k].reshape(n, k)
    gaps = (quotients << np.uint64(k)) | np.packbits(rest).view(">u8").astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


_SENT = pa.schema(
    [("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("fp", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("code", pa.binary())]
)
_SENT_DDL = "block long, place int, doc_id long, n_chars long, sha binary, fp long, owner int, n int, k int, code binary"


def owner_ranges(sorted_fps: np.ndarray, owners: int) -> np.ndarray:
    """The first index of each owner's range, and the length at the end."""
    width = (1 << 64) // owners + 1
    return np.append(np.searchsorted(sorted_fps, np.array([width * i for i in range(owners)], np.uint64)), len(sorted_fps))


def _send(owners: int):
    width = (1 << 64) // owners + 1

    def messages(block: int, fps: np.ndarray) -> pa.RecordBatch:
        own = np.unique(fps)
        cuts, out = owner_ranges(own, owners), []
        for i in range(owners):
            part = own[cuts[i] : cuts[i + 1]]
            if len(part):
                out.append((i, len(part), *golomb_encode(part - np.uint64(width * i), width.bit_length())))
        n, (owner, count, k, code) = len(out), zip(*out)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.int64()), pa.array(owner, pa.int32()), pa.array(count, pa.int32()), pa.array(k, pa.int32()), pa.array(code, pa.binary())], schema=_SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        block, held = 0, []
        size = 0
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                batch = whole.slice(at, BLOCK)
                if held and size + len(batch) > BLOCK:
                    yield messages(first + block, np.concatenate(held))
                    block, held, size = block + 1, [], 0
                shas = [hashlib.sha256(t.translate(None, SPACE)).digest() for t in batch.column(1).cast(pa.binary()).to_pylist()]
                fps = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64)
                n = len(shas)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, first + block)), pa.array(np.arange(size, size + n, dtype=np.int32)), batch.column(0), pc.utf8_length(batch.column(1)).cast(pa.int64()), pa.array(shas, pa.binary()), pa.array(fps.view(np.int64)), *(pa.nulls(n, _SENT.field(i).type) for i in range(6, 10))],
                    schema=_SENT,
                )
                held.append(fps)
                size += n
        if size:
            yield messages(first + block, np.concatenate(held))

    return send


def _answer(owners: int):
    width = (1 << 64) // owners + 1

    def answer(lists: pd.DataFrame) -> pd.DataFrame:
        decoded = [golomb_decode(n, k, code) for n, k, code in zip(lists["n"], lists["k"], lists["code"])]
        values, seen = np.unique(np.concatenate(decoded), return_counts=True)
        shared = values[seen > 1]
        maps = [np.packbits(np.isin(d, shared)).tobytes() for d in decoded]
        return pd.DataFrame({"block": lists["block"], "owner": lists["owner"], "bitmap": maps})

    return answer


def _mark(owners: int):
    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """The suspects of one block: by the owners' bitmaps, or repeated in the block."""
        fps = rows["fp"].to_numpy().view(np.uint64)
        own, where, seen = np.unique(fps, return_inverse=True, return_counts=True)
        cuts, shared = owner_ranges(own, owners), seen > 1
        for owner, bitmap in zip(answers["owner"], answers["bitmap"]):
            start, stop = cuts[owner], cuts[owner + 1]
            shared[start:stop] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=stop - start).astype(bool)
        return rows.loc[shared[where], ["block", "place", "doc_id", "n_chars", "sha"]]

    return mark


def exact_duplicates(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text).

    ``owners``: hash ranges of the exchange; if None, one for each shuffle partition of the
    session, or for each ``OWNER_ROWS`` rows if those are more.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sent = materialise(rows.mapInArrow(_send(owners), _SENT_DDL), "fingerprints")
    prints = sent.filter(F.col("owner").isNull())
    n = prints.count()
    bitmaps = sent.filter(F.col("owner").isNotNull()).select("block", "owner", "n", "k", "code").groupBy("owner").applyInPandas(_answer(owners), "block long, owner int, bitmap binary")
    suspects = materialise(
        prints.select("block", "place", "doc_id", "n_chars", "sha", "fp").groupBy("block").cogroup(bitmaps.groupBy("block")).applyInPandas(_mark(owners), "block long, place int, doc_id long, n_chars long, sha binary"),
        "suspects",
        n,
    )
    ids = suspects.select(F.col("doc_id").alias("suspect_id")).distinct()
    # The ids grow with the table, so they are hashed in parts and never broadcast; texts are not sorted.
    texts = rows.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("suspect_id")), "left_semi").select(F.translate("text", SPACE.decode(), "").alias("bytes"))
    by_bytes = texts.groupBy("bytes").agg(F.count("*").alias("group_size")).select(F.unhex(F.sha2("bytes", 256)).alias("group_sha"), "group_size")
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("block").alias("not_block"), F.bitwise_not("place").alias("not_place")))
    keepers = suspects.groupBy("sha").agg(best.alias("best"), F.count("*").alias("members"))
    groups = keepers.join(by_bytes, keepers["sha"] == by_bytes["group_sha"], "left").select(
        F.col("sha").alias("group_sha"),
        F.when(F.col("members") == F.col("group_size"), F.col("group_size")).otherwise(F.raise_error(F.lit("texts with one hash differ in their bytes"))).alias("group_size"),
        F.bitwise_not(F.col("best.not_id")).alias("keep_id"),
        F.bitwise_not(F.col("best.not_block")).alias("keep_block"),
        F.bitwise_not(F.col("best.not_place")).alias("keep_place"),
    )
    # A hot group's answer goes to each block once, then to the block's rows: no key of
    # either join has more rows than there are blocks, or than a block has.
    answers = suspects.select("block", "sha").distinct().join(groups, F.col("sha") == F.col("group_sha")).drop("sha").withColumnRenamed("block", "own_block")
    grouped = prints.join(answers, (F.col("block") == F.col("own_block")) & (F.col("sha") == F.col("group_sha")), "left")
    alone = F.col("group_sha").isNull()
    return grouped.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("block") == F.col("keep_block")) & (F.col("place") == F.col("keep_place")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
