import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notegraph.llm import tokens
from notegraph.llm.queries import op7_token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return tokens.Encoder(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 100))
def test_elias_fano(values, spare):
    values = np.array(sorted(values), np.int64)
    universe = int(values[-1]) + spare if len(values) else spare
    data = tokens.EliasFano.encode(values, universe)
    sequence, size = tokens.EliasFano.read(memoryview(data + b"rest"), len(values), universe)
    assert size == len(data) and np.array_equal(sequence.all(), values)
    assert [sequence.select(i) for i in range(len(values))] == values.tolist()


def test_space_of_the_boundaries():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(tokens.EliasFano.encode(ends, int(ends[-1]))) * 8 < 10_000 * (np.log2(ends[-1] / 10_000) + 3)


pieces = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", " ", "　", "\x1c", "a", "the", "don't", "é", "日本", "123", ",", "...", "<|endoftext|>", "Word", "#", "\U0001f600"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=12).map("".join), max_size=6))
def test_batches_give_the_ids_of_the_library(coder, library, texts):
    ids, lengths = coder.encode(pa.array(texts, pa.string()), 0)
    wanted = [[*library(t), 0] for t in texts]
    assert lengths.tolist() == [len(w) for w in wanted] and ids.tolist() == [x for w in wanted for x in w]


@pytest.mark.parametrize("kept", [0, 3, 40, 1000])
def test_words_kept_from_batch_to_batch(library, prose, monkeypatch, kept):
    monkeypatch.setattr(tokens, "KEPT_WORDS", kept)
    own = tokens.Encoder(VOCABULARY)
    for seed in range(6):
        texts = [prose(30, seed), "", "é don't " + prose(40, seed % 3).replace(" ", "1 "), "a  b", "<|endoftext|> x"]
        ids, lengths = own.encode(pa.array(texts), 0)
        assert ids.tolist() == [x for t in texts for x in [*library(t), 0]] and lengths.tolist() == [len(library(t)) + 1 for t in texts]
    assert len(own.known) <= kept and np.count_nonzero(own.spaced[own.kept]) == len(own.known)


def test_strings_of_added_tokens(coder, library):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "plain words", "<|endoftext", ""]
    ids, lengths = coder.encode(pa.array(texts), 0)
    assert library(texts[0]) == [64, 220, 50256, 275]
    assert ids.tolist() == [x for t in texts for x in [*library(t), 0]] and lengths.tolist() == [len(library(t)) + 1 for t in texts]


def read(spark, rows, tmp_path, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, data int").repartition(parts)
    return tokens.token_files(df, VOCABULARY, str(tmp_path / "out"))


def test_files_against_the_library(spark, library, tmp_path, prose):
    rows = [(i, prose(i % 50, i), "x", 1) for i in range(200)] + [(500, None, "x", 1), (501, "", "x", 1), (502, prose(30_000), "x", 1), (-5, "a  b", "x", 1), (None, "null id", "x", 1)]
    got = [tuple(r) for r in read(spark, rows, tmp_path).collect()]
    at, wanted = 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library(text or ""), 0], "<u4")
        wanted.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == wanted


def test_repeated_ids_each_have_an_entry(spark, tmp_path):
    got = sorted(read(spark, [(7, "b", "", 0), (7, "a", "", 0), (7, "a", "", 0), (1, "c c", "", 0)], tmp_path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1, 7, 7, 7] and sum(r["n_tokens"] for r in got[:-1]) == got[-1]["start"]


def test_empty_table(spark, tmp_path):
    assert read(spark, [], tmp_path).collect() == []


def test_blocks(coder, prose):
    ids, lengths = coder.encode(pa.array([prose(20, i) for i in range(100)]), 0)
    data = tokens.pack_block(ids, lengths)
    block = tokens.Block(data)
    ends = np.cumsum(lengths)
    assert all(np.array_equal(block.document(i), ids[ends[i] - lengths[i] : ends[i]]) for i in range(100))
    assert len(data) < 2 * len(ids) + 400
    with pytest.raises(ValueError):
        tokens.Block(b"nope" + data[4:])


def test_small_blocks_join_up(prose, monkeypatch):
    rows = [(i, prose(40, i)) for i in range(60)]
    monkeypatch.setattr(tokens, "BLOCK_IDS", 100)
    out = [b for b in _write_locally(rows)]
    assert len(out) > 10 and [d for b in out for d in b["doc_ids"]] == list(range(60))
    assert [b["start"] for b in out] == np.cumsum([0, *[b["n_ids"] for b in out[:-1]]]).tolist()


def _write_locally(rows):
    coder, out = tokens.Encoder(VOCABULARY), []
    writer = tokens.BlockWriter(0)
    texts = pa.array([t for _, t in rows])
    for at, n in tokens.slices(texts):
        ids, lengths = coder.encode(texts.slice(at, n), 0)
        out += [b.to_pylist()[0] for b in writer.add(pa.array([i for i, _ in rows][at : at + n]), ids, lengths)]
    out += [b.to_pylist()[0] for b in writer.rest()]
    return out


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(op7_token_files(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    at = 0
    for d, g in zip(docs, got, strict=True):
        ids = np.array([*library(d["text"] or ""), 0], "<u4")
        assert tuple(g) == (d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
