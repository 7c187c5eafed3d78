import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notegraph.llm import chat, queries

ROWS = "conv_id long, turn long, role string, text string"


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("\\#<>/turn \n:a"), max_size=30), st.text(st.sampled_from("\\#<\nab "), max_size=6))
def test_any_turn_reads_back(text, role):
    block, level, start, stop = chat.render_turn(role, text)
    assert chat.read_turn(block) == (role, text, start, stop, len(block))
    assert chat.unescape(block[start:stop]) == text
    following = block + chat.render_turn("user", "next")[0]  # turns follow one another without doubt
    assert chat.read_turn(following)[:2] == (role, text) and chat.read_turn(following, len(block))[:2] == ("user", "next")


def test_levels():
    level = lambda t: chat.render_turn("user", t)[1]
    assert [level(t) for t in ("plain", "C:\\dir", "a # b < c", "### x", "</turn>", "\\\\", "####", queries.PLANTED)] == [0, 0, 0, 1, 1, 1, 2, 1]


@pytest.mark.parametrize("block", ["", "x", "### user", "### user\ntext", "### user\ntext\n</turn>", "### user\ntext</turn>\n", "### user\n### a\n</turn>\n"])
def test_grammar_is_strict(block):
    with pytest.raises(ValueError):
        chat.read_turn(block)


def digests(spark, rows):
    return {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, ROWS))).collect()}


def test_digests_against_the_source(spark, prose):
    rows = [(1, 1, "assistant", "b </turn>"), (1, 0, "user", None), (1, 2, "assistant", "é### x"), (1, 2, "assistant", "é### x"), (2, 0, None, ""), (None, 0, "assistant", "n"), (3, 0, "assistant", prose(60_000))]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"t{i} \\#") for i in range(3000)]  # one conversation has most of all rows
    got = digests(spark, rows)
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        mine = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv]["formatted_chars"] == sum(len(chat.render_turn(r, x)[0]) for _, r, x in mine)


def test_unlike_texts_on_one_turn_and_null_turns(spark):
    rows = [(1, 0, "user", t) for t in ("### x", "Z", "\\#", "", "</turn>", "a", "é", "###")] + [(1, 0, "assistant", "z"), (1, 0, "user", "Z"), (1, None, "user", "no turn"), (1, None, "assistant", "### none"), (1, 5, "a#b", "t"), (1, 5, "a", "u"), (2, None, None, None)]
    got = digests(spark, rows)
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    wanted = db.execute(queries.ORACLE_SQL["op1_chat_format"])
    names = [d[0] for d in wanted.description]
    assert sorted(tuple(r[n] for n in names) for r in got.values()) == sorted(r for r in wanted.fetchall() if r[0] != -7)
    for conv in (1, 2):
        mine = sorted((t is None, t, (r or "").encode(), (x or "").encode()) for c, t, r, x in rows if c == conv)
        assert got[conv]["turns_sha256"] == hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, _, r, x in mine)).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(b"".join(x for _, _, r, x in mine if r == b"assistant")).hexdigest()


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], ROWS + ", formatted int, loss_start string")
    assert chat.read_back(chat.format_turns(df)).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "x", 5, "y")], ROWS + ", formatted int, escape_level string")
    assert chat.read_back(chat.format_turns(df)).first()["n_turns"] == 1


def test_query_and_sql(spark, sf_dir):
    got = queries.op1_chat_format(spark, sf_dir)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    wanted = db.execute(queries.ORACLE_SQL["op1_chat_format"])
    names = [d[0] for d in wanted.description]
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(wanted.fetchall())
