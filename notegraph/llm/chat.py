"""Chat formatting with a grammar round trip.

Template of a turn: ``### ROLE``, newline, body, newline, ``</turn>``, newline.
``###`` and ``</turn>`` are control strings; a backslash before a backslash,
``#`` or ``<`` makes that character literal (in a role also ``\\n`` for a newline).
Each turn is rendered, parsed again by the deterministic parser below and compared
with its source; while the two differ, the text is escaped at the next level:

0. verbatim, 1. backslashes doubled and each control string escaped once,
2. every backslash, ``#`` and ``<`` escaped (always unambiguous).

Defined cases: a null role or text counts as empty; turns are ordered by turn (null
last), ties by role and then text, both as UTF-8 bytes (repeated rows all stay); a very
long text is rendered and read whole, like any other; a null conv_id is one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, END = "###", "</turn>"
_SPECIAL = re.compile(r"[\\#<]")
_TOKEN = re.compile(r"\\[\\#<]|###|</turn>")


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return text.replace("\\", "\\\\").replace(MARK, "\\" + MARK).replace(END, "\\" + END)
    return _SPECIAL.sub(r"\\\g<0>", text)


def escape_role(role: str) -> str:
    return escape(role, 2).replace("\n", "\\n")


def read_turn(block: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Parse the turn at ``at``: (role, text, body start, body end, end of block).

    ValueError if the block does not follow the grammar.
    """
    if not block.startswith(MARK + " ", at):
        raise ValueError("no turn mark")
    head_end = block.find("\n", at)
    if head_end < 0:
        raise ValueError("open role")
    role = re.sub(r"\\([\\#<n])", lambda m: "\n" if m[1] == "n" else m[1], block[at + len(MARK) + 1 : head_end])
    start = head_end + 1
    for m in _TOKEN.finditer(block, start):
        if m[0] == MARK:
            raise ValueError("turn mark inside a body")
        if m[0] == END:
            stop = m.start() - 1
            if stop < start or block[stop] != "\n" or not block.startswith("\n", m.end()):
                raise ValueError("misplaced end of turn")
            return role, unescape(block[start:stop]), start, stop, m.end() + 1
    raise ValueError("open turn")


def unescape(body: str) -> str:
    return re.sub(r"\\([\\#<])", r"\1", body)


def render_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """(block, escape level, body start, body end) of the first level that reads back as written."""
    for level in (0, 1, 2):
        block = f"{MARK} {escape_role(role)}\n{escape(text, level)}\n{END}\n"
        try:
            got = read_turn(block)
        except ValueError:
            continue
        if got[:2] == (role, text) and got[4] == len(block):
            return block, level, got[2], got[3]
    raise AssertionError("a fully escaped turn must read back")


_TURNS = "conv_id long, turn long, formatted string, escape_level int, loss_start long, loss_end long"


def format_turns(conversations: DataFrame) -> DataFrame:
    """One rendered block for each turn, without a shuffle.

    ``loss_start`` and ``loss_end`` are the code points of the escaped assistant
    text inside ``formatted`` (null for other roles).  A conversation's training
    text is its blocks joined in the order of (turn, role, text).
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, roles, texts = (batch.column(i) for i in range(4))
            blocks = [(role, *render_turn(role, text)) for role, text in zip(roles.to_pylist(), texts.to_pylist())]
            loss = [b[0] == "assistant" for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [
                    conv,
                    turn,
                    pa.array([b[1] for b in blocks], pa.string()),
                    pa.array([b[2] for b in blocks], pa.int32()),
                    pa.array([b[3] if x else None for b, x in zip(blocks, loss)], pa.int64()),
                    pa.array([b[4] if x else None for b, x in zip(blocks, loss)], pa.int64()),
                ],
                ["conv_id", "turn", "formatted", "escape_level", "loss_start", "loss_end"],
            )

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    return rows.mapInArrow(render, _TURNS)


_READ = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.string()), ("masked", pa.bool_()), ("chars", pa.int64()), ("escaped", pa.bool_())])
_READ_DDL = "conv_id long, turn long, role string, text string, loss string, masked boolean, chars long, escaped boolean"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("escaped_turns", pa.int64())])
_DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long"


def read_turns(turns: DataFrame) -> DataFrame:
    """Role, text and loss of each rendered block, read from it alone.

    ``masked`` says that the block has a loss mask; ``loss`` is the text under it where
    that differs from the turn's text (null else, so that no text is carried twice).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, *columns = (batch.column(n) for n in ("conv_id", "turn", "formatted", "escape_level", "loss_start", "loss_end"))
            rows = []
            for block, level, start, stop in zip(*(c.to_pylist() for c in columns)):
                role, text, _, _, end = read_turn(block)
                if end != len(block):
                    raise ValueError("text after the end of a turn")
                under = text if start is None else unescape(block[start:stop])
                rows.append((role, text, None if under == text else under, start is not None, len(block), level > 0))
            yield pa.RecordBatch.from_arrays([conv, turn, *(pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 6, list(_READ)[2:]))], schema=_READ)

    return turns.mapInArrow(read, _READ_DDL)


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, from what ``read_turns`` reads in the rendered blocks.

    A digest needs its conversation's turns in order, so they are dealt by
    conversation, sorted by Spark (which spills) and read as a stream: a task
    holds one batch and two hash states, however long a conversation is.
    """

    class Digest:
        def __init__(self, conv):
            self.conv, self.n, self.loss, self.chars, self.escaped = conv, 0, 0, 0, 0
            self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

        def add(self, role, text, loss, masked, chars, escaped):
            self.n, self.chars, self.escaped = self.n + 1, self.chars + chars, self.escaped + escaped
            self.turns_hash.update(f"{role}\n{text}\n".encode())
            if masked:
                under = text if loss is None else loss
                self.loss += len(under)
                self.loss_hash.update(under.encode())

        def row(self):
            return (self.conv, self.n, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars, self.escaped)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _DIGEST)], schema=_DIGEST)
        now = None
        for batch in batches:
            done = []
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "loss", "masked", "chars", "escaped")]
            for conv, *turn in zip(*columns):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(conv)
                now.add(*turn)
            if done:
                yield to_batch(done)
        if now is not None:
            yield to_batch([now.row()])

    order = ("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return read_turns(turns).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(fold, _DIGEST_DDL)
