"""Edits of a note's frontmatter lines that leave every other byte alone.

Each edit takes and returns a note's text with a description of the change, and
refuses what it could not do safely: nested keys, lists and maps, flow lists, block
scalars, tags that are not a block list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import EditError

_SPECIAL = re.compile(r"[:#\[\]{}'\"&*!|>%@]|^[ \-?]| $")
_BLOCK_SCALAR = re.compile(r"[|>][+-]?\Z")


@dataclass(frozen=True)
class Edit:
    """``kind``: set, unset, add_tag or remove_tag."""

    kind: str
    key: str
    value: str = ""


def quoted(value: str) -> str:
    """``value`` as a YAML scalar: quoted if a special character asks for it."""
    if not _SPECIAL.search(value):
        return value
    return '"' + value.replace('"', '\\"') + '"' if "'" in value else f"'{value}'"


class Frontmatter:
    """The lines between two ``---`` lines of a note, and the rest as it is."""

    def __init__(self, text: str):
        lines = re.split(r"\r?\n", text)
        close = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
        if not text or lines[0].strip() != "---" or close is None:
            raise EditError("the note has no frontmatter")
        ends = [m.end() for m in re.finditer(r"\n", text)]
        self.lines, self.newline = lines[: close + 1], "\r\n" if "\r\n" in text else "\n"
        self.body = text[ends[close] :] if close < len(ends) else ""

    def text(self) -> str:
        return self.newline.join(self.lines) + self.newline + self.body

    def find(self, key: str) -> int | None:
        """The line of a top-level key; a nested one is refused."""
        for i, line in enumerate(self.lines[1:-1], 1):
            if re.match(rf"\s*{re.escape(key)} ?:(?:[ \t]|\Z)", line):
                if line[:1].isspace():
                    raise EditError(f"field '{key}' is nested")
                return i
        return None

    def inline(self, at: int) -> str:
        return self.lines[at].partition(":")[2].strip()

    def extent(self, at: int) -> int:
        """How many lines a field takes."""
        value = self.inline(at)
        if value and value[0] not in "[{" and not _BLOCK_SCALAR.match(value):
            return 1
        n = 1
        for line in self.lines[at + 1 : -1]:
            if not line.strip() or not (line[0].isspace() or line.startswith("-")):
                break
            n += 1
        return n

    def is_flow_list(self, at: int) -> bool:
        value = self.inline(at)
        return value.startswith("[") and value.endswith("]")


def set_field(note: Frontmatter, key: str, value: str) -> str:
    line, at = f"{key}: {quoted(value)}", note.find(key)
    if at is None:
        note.lines.insert(len(note.lines) - 1, line)
        return f"set {key} = {value} (was: )"
    old = note.inline(at)
    if note.is_flow_list(at):
        raise EditError(f"field '{key}' is a flow list: unset it first")
    if _BLOCK_SCALAR.match(old):
        raise EditError(f"field '{key}' is a block scalar: unset it first")
    if note.extent(at) > 1:
        raise EditError(f"field '{key}' is a list or map: unset it first")
    note.lines[at] = line
    return f"set {key} = {value} (was: {old})"


def unset_field(note: Frontmatter, key: str) -> str:
    at = note.find(key)
    if at is None:
        raise EditError(f"field '{key}' not found")
    old, n = note.inline(at), note.extent(at)
    del note.lines[at : at + n]
    return f"unset {key} (was: {old})"


def _tags(note: Frontmatter) -> tuple[int, int]:
    at = note.find("tags")
    if at is None:
        raise EditError("no 'tags' field found")
    if note.inline(at):
        raise EditError("'tags' is not a block list")
    return at, note.extent(at)


def add_tag(note: Frontmatter, tag: str) -> str:
    at, n = _tags(note)
    item = next((re.match(r"(\s*)-(?: |\Z)", line) for line in note.lines[at + 1 : at + n] if re.match(r"\s*-(?: |\Z)", line)), None)
    note.lines.insert(at + n, f"{item[1] if item else '  '}- {tag}")
    return f"add tag: {tag}"


def remove_tag(note: Frontmatter, tag: str) -> str:
    at, n = _tags(note)
    for i in range(at + 1, at + n):
        if note.lines[i].strip().removeprefix("- ") == tag:
            del note.lines[i]
            return f"remove tag: {tag}"
    raise EditError(f"tag '{tag}' not found in tags list")


def apply_edits(text: str, edits: list[Edit]) -> tuple[str, list[str]]:
    """The edited text and what was changed; EditError if any edit is refused."""
    note, changes = Frontmatter(text), []
    for e in edits:
        if e.kind == "set":
            changes.append(set_field(note, e.key, e.value))
        elif e.kind == "unset":
            changes.append(unset_field(note, e.key))
        else:
            changes.append({"add_tag": add_tag, "remove_tag": remove_tag}[e.kind](note, e.key))
    return note.text(), changes
