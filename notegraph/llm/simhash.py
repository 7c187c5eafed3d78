"""SimHash near-duplicates found through deletion-variant signatures.

A text's words are its runs of non-white-space ASCII (A-Z lower-cased); a fingerprint
bit is 1 if it is set in over half of the XXH64 values (seed 42) of its 3-word
shingles.  Fingerprints that differ in at most 2 bits are linked.

Two fingerprints within 2 bits agree, up to one bit, in at least one of two 32-bit
segments.  Each distinct fingerprint is indexed under every variant of each segment
with one bit deleted; fingerprints that share a variant meet by equality and are
verified on all 64 bits.  A bucket of a few fingerprints compares all its pairs, a
larger one looks up each fingerprint with up to 2 bits flipped in the bucket's sorted
list, so work grows with the bucket and not with its square, and every bucket leaves
at most one link for each member.  Equal fingerprints were merged before, so a group
of copies is one entry however large it is.

Defined cases: a null text is empty; a very long text is hashed whole, piece by piece; a
text without words has fingerprint 0, and is
linked like any other; one or two words are one shingle; repeated rows share a
component; a null doc_id never is a component's least; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, identity, keep, materialise
from .components import components, forest

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Buckets of up to this many fingerprints compare pairs; beyond, flipped bits are looked up.
PAIRS_UP_TO = 512
#: Buckets of up to this many are compared together with their neighbours in the batch.
SMALL = 16


def shingles(words: list[bytes]) -> Iterator[bytes]:
    if len(words) < SHINGLE:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(SHINGLE))))


def fingerprint(raw: bytes) -> int:
    """The fingerprint of a UTF-8 text; bytes.split() and lower() handle just the ASCII characters meant."""
    words = raw.lower().split()
    if not words:
        return 0
    rest, digest, n, ones = shingles(words), xxhash.xxh64_digest, 0, np.zeros(64, np.int64)
    while part := b"".join([digest(s, SEED) for s in itertools.islice(rest, 8192)]):
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        n += len(bits)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(raw or b"") for raw in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64))


def fingerprint_column(text: str = "text") -> Column:
    return F.arrow_udf(_fingerprints, "long").asNondeterministic()(F.col(text))


def bucket_edges(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one bucket's fingerprints (distinct, in any order) within 2 bits."""
    if len(fps) <= PAIRS_UP_TO:
        i, j = np.triu_indices(len(fps), 1)
        near = np.bitwise_count(fps[i] ^ fps[j]) <= DISTANCE
        return forest(fps[j[near]], fps[i[near]])
    fps = np.sort(fps)  # they come in the order of signed longs
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))  # a bit that all share needs no flip
    free = [np.uint64(1 << k) for k in range(64) if differ >> k & 1]
    links = (fps[:0], fps[:0])
    for masks in itertools.batched([*free, *(x | y for x, y in itertools.combinations(free, 2))], 32):
        found = [links]
        for mask in masks:
            other = fps ^ mask
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = (fps[at] == other) & (fps > other)
            found.append((fps[hit], other[hit]))
        links = forest(*map(np.concatenate, zip(*found)))
    return links


def _deleted(value: np.ndarray, bits: int) -> np.ndarray:
    """Keys (deleted bit, value without it) of each value of ``bits`` bits: one column for each bit."""
    at = np.arange(bits, dtype=np.uint64)
    return at << np.uint64(bits) | (value[:, None] & ~(np.uint64(1) << at))


def _low(value: np.ndarray, bits: int) -> np.ndarray:
    return value & np.uint64((1 << bits) - 1)


def _batch(key: np.ndarray, fps: np.ndarray, variants: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fps, variants).view(np.int64))], ["variant", "fp"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """64 variants of each fingerprint: each 32-bit segment with each of its bits deleted."""
    for batch in batches:
        for at in range(0, len(batch), 8192):
            fps = batch.column(0).slice(at, 8192).to_numpy().view(np.uint64)
            keys = [np.uint64(s << 37) | _deleted(_low(fps >> np.uint64(32 * s), 32), 32) for s in (0, 1)]
            yield _batch(np.concatenate(keys, 1), fps, 64)


def _subvariants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 finer variants of (fp, variant): the 16-bit halves of the other segment, one bit deleted.

    Members of one finer bucket share at least 46 bits, so it holds 2**18 at most.
    """
    for batch in batches:
        for at in range(0, len(batch), 8192):
            fps, key = (batch.column(i).slice(at, 8192).to_numpy().view(np.uint64) for i in (0, 1))
            other = _low(np.where(key >> np.uint64(37) & np.uint64(1), fps, fps >> np.uint64(32)), 32)
            keys = [key[:, None] << np.uint64(21) | np.uint64(h << 20) | _deleted(_low(other >> np.uint64(16 * h), 16), 16) for h in (0, 1)]
            yield _batch(np.concatenate(keys, 1), fps, 32)


def _linker(split_over: int):
    def flush(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
        sizes = np.diff(starts, append=len(key))
        size_at = np.repeat(sizes, sizes)
        found = [(fps[:0], fps[:0])]
        for step in range(1, SMALL):  # all small buckets at once
            same = (key[step:] == key[:-step]) & (size_at[step:] <= SMALL)
            a, b = fps[step:][same], fps[:-step][same]
            near = np.bitwise_count(a ^ b) <= DISTANCE
            found.append((a[near], b[near]))
            if not same.any():
                break
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            found.append(bucket_edges(fps[s : s + n]))
        a, b = forest(*map(np.concatenate, zip(*found)))
        return rows(a, b, np.zeros(0, np.int64))

    def rows(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        """Links (a, b), or members (a, variant) of a bucket to be split."""
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if len(b) else pa.nulls(n, pa.int64()), pa.array(key) if len(key) else pa.nulls(n, pa.int64())], ["a", "b", "variant"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a task come sorted by variant and fp; a bucket may go on in the next batch."""
        key, fps, splitting = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            new_key, new_fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if splitting is not None:
                n = int(np.searchsorted(new_key, splitting, "right"))
                if n:
                    yield rows(new_fps[:n], new_fps[:0], new_key[:n])
                    new_key, new_fps = new_key[n:], new_fps[n:]
                if len(new_key):
                    splitting = None
            key, fps = np.concatenate((key, new_key)), np.concatenate((fps, new_fps))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield flush(key[:last], fps[:last])
                key, fps = key[last:], fps[last:]
            if len(key) > split_over:
                yield rows(fps, fps[:0], key)
                splitting, key, fps = key[-1], key[:0], fps[:0]
        if len(key):
            yield flush(key, fps)

    return link


def fingerprint_links(fps: DataFrame, split_over: int = 1 << 17) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fps`` (fp) within 2 bits of each other.

    Buckets of more than ``split_over`` members are split by finer variants and never held whole.
    """
    meet = lambda variants, over: variants.repartition("variant").sortWithinPartitions("variant", "fp").mapInArrow(_linker(over), "a long, b long, variant long")
    first = keep(meet(fps.select("fp").mapInArrow(_variants, "variant long, fp long"), split_over))
    links, large = first.filter("b is not null").select("a", "b"), first.filter("variant is not null").select("a", "variant")
    if not large.isEmpty():
        finer = meet(large.mapInArrow(_subvariants, "variant long, fp long"), 1 << 18)
        links = links.union(finer.select("a", "b"))
    return links


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, component) for the distinct values of ``fps`` (fp); the component is a member's fp."""
    linked = components(fingerprint_links(fps)).select(F.col("node").alias("linked_fp"), "component")
    return fps.join(linked, F.col("fp") == F.col("linked_fp"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def _members(distinct: DataFrame, rows: int) -> DataFrame:
    """The rows of ``distinct`` (fp, ...), one for each fingerprint, with their component."""
    found = fingerprint_components(distinct).withColumnRenamed("fp", "member_fp")
    return materialise(distinct.join(found, F.col("fp") == F.col("member_fp")).drop("member_fp"), "simhash-components", rows)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    prints = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column().alias("fp")))
    n = prints.count()
    members = _members(materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct", n), n)
    ids = members.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = members.join(ids, "component").select(F.col("fp").alias("own_fp"), "component_id")
    return prints.join(by_fp, F.col("fp") == F.col("own_fp"), "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the one with the least doc_id.

    A null doc_id comes after all others; of rows that share the doc_id, the one whose
    text has the least XXH64, then the least in all columns.
    """
    bound_batches(docs.sparkSession)
    prints = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(), fingerprint_column().alias("fp")))
    n = prints.count()
    texts = prints.groupBy("fp", "doc_id", "text_1", "text_2").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_1", "text_2", "rows")).alias("first")
    members = _members(materialise(texts.groupBy("fp").agg(first), "simhash-distinct", n), n)
    kept = members.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_1").alias("kept_1"), F.col("first.text_2").alias("kept_2"), "first.rows")
    kept = materialise(kept, "simhash-kept", n)
    # The ids grow with the table, so they are hashed in parts and never broadcast; texts are not sorted.
    same = lambda ids: docs["doc_id"].eqNullSafe(ids["kept_id"]) & (F.xxhash64(docs["text"]) == ids["kept_1"]) & (F.xxhash64(F.lit("second"), docs["text"]) == ids["kept_2"])
    chosen = lambda ids: docs.join(ids.hint("shuffle_hash"), same(ids), "left_semi")
    single, repeated = chosen(kept.filter("rows = 1")), kept.filter("rows > 1")
    if repeated.isEmpty():
        return single
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = chosen(repeated).select("doc_id", *identity(), row.alias("r")).groupBy("doc_id", "text_1", "text_2").agg(F.min("r").alias("r"))
    return single.unionByName(again.select("r.*"))
