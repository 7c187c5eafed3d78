"""Edits of frontmatter lines."""

import pytest

from notegraph.errors import EditError
from notegraph.functions.editing import Edit, apply_edits, quoted

MOVIE = "---\naliases:\ntags:\n  - type/movie\n  - status/seen\nstatus: to-watch\nrating:\nyear: 1999\n---\n\nPart of [[List]]\n"


def edit(text, *edits):
    return apply_edits(text, [Edit(*e) for e in edits])


def test_set():
    assert edit(MOVIE, ("set", "status", "seen"))[0] == MOVIE.replace("to-watch", "seen")
    assert edit(MOVIE, ("set", "rating", "8")) == (MOVIE.replace("rating:\n", "rating: 8\n"), ["set rating = 8 (was: )"])
    assert edit(MOVIE, ("set", "mood", "a: b"))[0] == MOVIE.replace("1999\n---", "1999\nmood: 'a: b'\n---")
    assert edit("---\n---\nBody", ("set", "a", "1"))[0] == "---\na: 1\n---\nBody"


def test_unset_and_tags():
    assert edit(MOVIE, ("unset", "tags"))[0] == MOVIE.replace("tags:\n  - type/movie\n  - status/seen\n", "")
    assert edit(MOVIE, ("add_tag", "new"))[0] == MOVIE.replace("seen\n", "seen\n  - new\n", 1)
    assert edit(MOVIE, ("remove_tag", "type/movie"))[0] == MOVIE.replace("  - type/movie\n", "")
    flat = "---\ntags:\n- a\n- b\nx: 1\n---\n"
    assert edit(flat, ("add_tag", "c"))[0] == flat.replace("- b\n", "- b\n- c\n")
    assert edit("---\ntags:\nx: 1\n---\n", ("add_tag", "c"))[0] == "---\ntags:\n  - c\nx: 1\n---\n"
    block = "---\nd: |\n  one\n  two\nx: 1\n---\n"
    assert edit(block, ("unset", "d"))[0] == "---\nx: 1\n---\n"  # the text of a block scalar goes too


def test_endings_and_order_are_kept():
    text = MOVIE.replace("\n", "\r\n")
    out, changes = edit(text, ("set", "status", "x"), ("unset", "rating"), ("add_tag", "n"))
    assert out == text.replace("to-watch", "x").replace("rating:\r\n", "").replace("seen\r\n", "seen\r\n  - n\r\n", 1)
    assert changes == ["set status = x (was: to-watch)", "unset rating (was: )", "add tag: n"]


@pytest.mark.parametrize(
    "text, change",
    [
        (MOVIE, ("set", "tags", "x")),
        (MOVIE, ("unset", "nothing")),
        (MOVIE, ("remove_tag", "absent")),
        ("---\ntags: [a, b]\n---\n", ("set", "tags", "x")),
        ("---\ntags: [a, b]\n---\n", ("add_tag", "x")),
        ("---\ntags: foo\n---\n", ("add_tag", "x")),
        ("---\nd: |\n  t\n---\n", ("set", "d", "x")),
        ("---\na:\n  b: 1\n---\n", ("set", "b", "2")),
        ("no frontmatter", ("set", "a", "1")),
        ("---\nopen: 1\n", ("set", "a", "1")),
        ("", ("set", "a", "1")),
    ],
)
def test_refusals(text, change):
    with pytest.raises(EditError):
        edit(text, change)


def test_quoting():
    assert [quoted(x) for x in ("plain", "a: b", "it's #1", "- x", "true", "[x]", " pad", 'say "hi"')] == ["plain", "'a: b'", '"it\'s #1"', "'- x'", "true", "'[x]'", "' pad'", "'say \"hi\"'"]
