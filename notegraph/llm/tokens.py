"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A data set is a Parquet folder of blocks in ascending order of doc_id.  Each block is
one self-contained binary (``data``): a header, the document ends as an Elias-Fano
sequence with select samples, and the ids of all its documents, each closed by the end
id, as little-endian integers of 2 bytes (4 if the vocabulary needs it).  Beside it
stand the block's doc_ids and its place: shard (range partition), number and start
within the shard.  Only one number for each shard is summed up to get global offsets.

Header, little-endian: magic ``EFTK``, version u16, bytes of an id u16, documents u64,
ids u64.  Sequence of n ends below or equal to u: with l = max(0, floor(log2(u / n)))
the low l bits of each end, packed; then the high parts as a bit vector in which the
i-th one stands at high(i) + i; then the place of every 64th one as u32.

Defined cases: a null text is empty (one end id); a very long text is encoded whole, by
one call that needs some times its bytes, and makes a block of its own; rows that share
a doc_id come one after the other, by a hash of their text, each with its own entry (of
equal rows either may be first); a null doc_id comes first; the string of an added token
inside a text becomes that token, as the library has it; an empty table gives no blocks;
other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, own_folder

MAGIC, VERSION, HEADER, SAMPLE = b"EFTK", 1, struct.Struct("<4sHHQQ"), 64
#: Ids after which a block is closed (a document is never split).
BLOCK_IDS = 1 << 20
#: Bytes of text whose distinct words are encoded together, and words joined for one call.
SLICE_BYTES = 10 << 20
WORDS_AT_ONCE = 512
#: Words whose ids a worker keeps from batch to batch, the first it meets: some tens of MB.
KEPT_WORDS = 250_000
#: Nothing, or a white-space character at the end: those of Unicode and some separators.
ENDS_IN_SPACE = r"(?:^|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])\z"


class EliasFano:
    """A non-decreasing sequence in near-minimal space; ``select(i)`` without a 64-bit table."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @staticmethod
    def shape(n: int, universe: int) -> tuple[int, int, int, int]:
        """(low bits, bytes of the low part, of the high part, samples)."""
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        return bits, (n * bits + 7) // 8, (n + (universe >> bits) + 8) // 8, (n + SAMPLE - 1) // SAMPLE

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        bits, low_bytes, high_bytes, _ = cls.shape(n, universe)
        low = np.unpackbits((values & ((1 << bits) - 1)).astype(">u8").view(np.uint8)).reshape(n, 64)[:, 64 - bits :]
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(high_bytes * 8, np.uint8)
        high[ones] = 1
        return np.packbits(low).tobytes().ljust(low_bytes, b"\0") + np.packbits(high).tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    @classmethod
    def read(cls, data: memoryview, n: int, universe: int) -> tuple[EliasFano, int]:
        """(sequence, its length in bytes)."""
        bits, low, high, samples = cls.shape(n, universe)
        part = lambda at, size, kind: np.frombuffer(data[at : at + size], kind)
        return cls(n, bits, part(0, low, np.uint8), part(low, high, np.uint8), part(low + high, 4 * samples, "<u4")), low + high + 4 * samples

    def _low_at(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        whole = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "big")
        return whole >> (-last % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, ones are counted."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        left += int(np.bitwise_count(self.high[byte] >> np.uint8(8 - at % 8))) if at % 8 else 0
        while left >= (ones := int(np.bitwise_count(self.high[byte]))):
            left, byte = left - ones, byte + 1
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1]))[left])
        return (place - i) << self.low_bits | (self._low_at(i) if self.low_bits else 0)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        low = np.zeros((self.n, 64), np.uint8)
        low[:, 64 - self.low_bits :] = np.unpackbits(self.low, count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return (ones - np.arange(self.n)) << self.low_bits | np.packbits(low).view(">u8").astype(np.int64)


def pack_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The binary of documents whose ids follow one another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return HEADER.pack(MAGIC, VERSION, ids.dtype.itemsize, len(ends), len(ids)) + EliasFano.encode(ends, len(ids)) + ids.tobytes()


class Block:
    """A packed block: document i's ids by two selects."""

    def __init__(self, data: bytes):
        magic, version, self.id_bytes, self.n, self.total = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block")
        self.ends, size = EliasFano.read(memoryview(data)[HEADER.size :], self.n, self.total)
        self.ids = np.frombuffer(data, f"<u{self.id_bytes}", self.total, HEADER.size + size)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class Encoder:
    """The tokenizers library over batches of texts, each distinct word of a batch once.

    The vocabulary's pre-tokenizer always cuts between a non-space character and a
    space, so the ids of a text are those of its pieces " word", one after the other.
    The distinct pieces of a batch are encoded together, told apart by the space that
    starts each, and laid out for all texts by array operations; the ids of the first
    ``KEPT_WORDS`` distinct words are kept for later batches.  First words, texts in
    which a space follows white space, and texts that hold an added token (such as an end
    mark, which the library turns into its id) go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.id_bytes = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.id_bytes}")
        self.known: dict[str, int] = {}  # places of the words kept: their ids follow one another in ``kept``
        self.kept = np.zeros(0, self.kind)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(size, bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True  # a space, as the byte-level alphabet writes it

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Arrays of ids whose parts that begin with a space are those of " word", in order."""
        out = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            ids = self.whole([" " + " ".join(part)])[0]
            if np.count_nonzero(self.spaced[ids]) != len(part):
                raise ValueError("the vocabulary does not cut words at spaces")
            out.append(ids)
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by the end id; number of ids of each text)."""
        n = len(texts)
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        del split
        odd = pc.match_substring_regex(coded.dictionary, ENDS_IN_SPACE).to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | (" " in token) | pc.match_substring(coded.dictionary, token).to_numpy(zero_copy_only=False)
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        heads = index[starts[:-1]]
        text_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
        odd_text = np.zeros(n, bool)
        odd_text[text_of[odd[index]]] = True

        used = np.zeros(len(words), bool)
        used[np.delete(index, starts[:-1])] = True
        plain = np.flatnonzero(used & ~odd)
        place_of = np.fromiter((self.known.get(words[i], -1) for i in plain.tolist()), np.int32, len(plain))
        new = plain[place_of < 0]
        pieces = self.words([words[i] for i in new.tolist()])
        # Entries: the words kept, new plain words, then first words, then odd texts, then the end id.
        firsts = np.unique(heads[~odd_text])
        odd_rows = np.flatnonzero(odd_text)
        others = [*self.whole([words[i] for i in firsts.tolist()]), *self.whole(texts.take(pa.array(odd_rows)).to_pylist()), np.array([end_id], self.kind)]
        flat = np.concatenate([self.kept, *pieces, *others])
        n_plain = len(self.kept) + sum(map(len, pieces))
        begins = np.concatenate((np.flatnonzero(self.spaced[flat[:n_plain]]), n_plain + np.cumsum([0, *map(len, others)]))).astype(np.int32)
        n_known, n_words = len(self.known), len(self.known) + len(new)
        place_of[place_of < 0] = n_known + np.arange(len(new))
        entry = np.zeros(len(words), np.int32)
        entry[plain] = place_of
        if stay := min(len(new), KEPT_WORDS - n_known):
            self.known |= {words[i]: n_known + k for k, i in enumerate(new[:stay].tolist())}
            self.kept = flat[: begins[n_known + stay]].copy()
        del words, pieces, others
        order = entry[index]
        order[starts[:-1]] = n_words + np.searchsorted(firsts, heads).clip(max=max(len(firsts) - 1, 0))
        order[starts[odd_rows]] = n_words + len(firsts) + np.arange(len(odd_rows))
        keep = ~odd_text[text_of]
        keep[starts[odd_rows]] = True
        counts = np.bincount(text_of[keep], minlength=n)
        order = np.insert(order[keep], np.cumsum(counts), len(begins) - 2)
        del index, text_of, keep, coded
        # Copy each entry's ids to its place; positions fit in 32 bits, as the texts' bytes do.
        sizes = np.diff(begins)[order]
        stops = np.cumsum(sizes, dtype=np.int32)
        lengths = np.add.reduceat(sizes, np.cumsum(counts + 1) - counts - 1).astype(np.int64) if n else sizes.astype(np.int64)
        place = np.repeat(begins[order] - stops + sizes, sizes)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place], lengths


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of up to ``SLICE_BYTES`` together, or of one text."""
    ends = np.cumsum(np.concatenate(([0], pc.binary_length(texts).to_numpy()))).astype(np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield at, stop - at
        at = stop


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``SLICE_BYTES``, for words that recur."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])
_BLOCKS_DDL = "shard int, block int, start long, n_ids long, doc_ids array<long>, data binary"


class BlockWriter:
    """Cuts the encoded documents of one shard into blocks, at document ends."""

    def __init__(self, shard: int):
        self.shard, self.block, self.start, self.size = shard, 0, 0, 0
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        stops, first = np.cumsum(lengths), 0
        while first < len(lengths):
            before = int(stops[first - 1]) if first else 0
            last = min(len(lengths), int(np.searchsorted(stops, before + BLOCK_IDS - self.size)) + 1)
            self.held.append((doc_ids.slice(first, last - first), ids[before : int(stops[last - 1])], lengths[first:last]))
            self.size += int(stops[last - 1]) - before
            if self.size >= BLOCK_IDS:
                yield from self.rest()
            first = last

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            doc_ids, ids, lengths = zip(*self.held)
            row = {"shard": self.shard, "block": self.block, "start": self.start, "n_ids": self.size, "doc_ids": pa.concat_arrays(doc_ids).to_pylist(), "data": pack_block(np.concatenate(ids), np.concatenate(lengths))}
            yield pa.RecordBatch.from_pylist([row], _BLOCKS)
            self.block, self.start, self.size, self.held = self.block + 1, self.start + self.size, 0, []


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) into the data set at ``path``, a folder that all executors share."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer = encoder(tokenizer), BlockWriter(TaskContext.get().partitionId())
        for batch in joined(batches):
            doc_ids, texts = batch.column(0), batch.column(1)
            for at, n in slices(texts):
                yield from writer.add(doc_ids.slice(at, n), *coder.encode(texts.slice(at, n), end_id))
        yield from writer.rest()

    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(write, _BLOCKS_DDL).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the blocks.

    A shard's start is the sum of the shards before it: one row for each partition of
    the writing job, which bounds the window and the broadcast below.
    """
    from pyspark.sql import Window

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, data in zip(*(batch.column(n) for n in ("first", "doc_ids", "data"))):
                block = Block(data.as_py())
                ends = block.ends.all()
                begins = np.concatenate(([0], ends[:-1]))
                wide = memoryview(block.ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(begins + start.as_py()), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(_BLOCKS_DDL).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(F.col("shard").alias("own"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(shards), F.col("shard") == F.col("own")).select((F.col("before") + F.col("start")).alias("first"), "doc_ids", "data")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the files (to a new shared folder if ``path`` is None) and read them back."""
    spark = docs.sparkSession
    path = path or f"{own_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path)
