"""Notes from files or from a table of texts.

A notes DataFrame has path, path_key (its parts; sorts component by component), name,
content, mtime, ctime, status, body_length and fields.  Parsing is one Arrow step that
Spark drops where no column of it is used: which notes are valid is told without it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FolderNotFound, VaultNotFound
from ..functions.frontmatter import invalid, parsed
from ..plans.fields import name_of
from ..session import materialise

#: The folder that marks a vault's root.
MARKER = ".obsidian"


def discover(start: str) -> str:
    """The nearest folder at or above ``start`` that holds the marker folder."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / MARKER).is_dir():
            return str(folder)
    raise VaultNotFound(f"no vault at or above {start}")


def resolve_folder(root: str, folder: str) -> str:
    path = os.path.join(root, folder) if folder not in ("", ".") else root
    if not os.path.isdir(path):
        raise FolderNotFound(folder)
    return path


def scan(path: str, recursive: bool) -> tuple[list[str], list[str]]:
    """(note files, folders to go on with) of one folder.

    Flat: every file (also through a link) whose ending is ``md``.  Recursive: links
    are not followed, and entries that start with a dot are left out.
    """
    files, folders = [], []
    with os.scandir(path) as entries:
        for e in entries:
            if not recursive:
                files += [e.path] if _is_note(e.name) and e.is_file() else []
            elif not e.name.startswith("."):
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.path)
                elif _is_note(e.name) and e.is_file(follow_symlinks=False):
                    files.append(e.path)
    return files, folders


def list_notes(path: str, recursive: bool) -> list[str]:
    """Note files of a folder, listed here; recursive: also of those below it, and none if its own name starts with a dot."""
    if recursive and os.path.basename(os.path.normpath(path)).startswith("."):
        return []
    found, folders = [], [path]
    while folders:
        files, below = scan(folders.pop(), recursive)
        found += files
        folders += below
    return sorted(found)


#: A tree of up to this many folders is walked by one task; beyond, each level's folders are dealt to all.
FOLDERS_A_TASK = 1_000


def listed(spark: SparkSession, path: str, recursive: bool) -> tuple[DataFrame, int]:
    """(path) of the files of ``list_notes``, listed by the tasks, and their number.

    A task walks down from its folders until it has seen ``FOLDERS_A_TASK``; what is left
    is dealt out anew.  Neither files nor folders reach the driver.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            folders = batch.column(0).to_pylist()
            while folders and seen < FOLDERS_A_TASK:
                files, below = scan(folders.pop(0), recursive)
                folders += below
                seen += 1
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array([False] * len(files), pa.bool_())], ["path", "is_folder"])
            yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array([True] * len(folders), pa.bool_())], ["path", "is_folder"])

    hidden = recursive and os.path.basename(os.path.normpath(path)).startswith(".")
    level, found = spark.createDataFrame([] if hidden else [(path,)], "path string").coalesce(1), None
    n = 0
    while True:
        out = materialise(level.mapInArrow(walk, "path string, is_folder boolean"), "listing")
        files = out.filter("not is_folder").select("path")
        found = files if found is None else found.unionByName(files)
        counts = dict(out.groupBy("is_folder").count().collect())
        n += counts.get(False, 0)
        if True not in counts:
            return found, n
        level = out.filter("is_folder").select("path").repartition(spark.sparkContext.defaultParallelism * 4)


def _is_note(name: str) -> bool:
    return os.path.splitext(name)[1] == ".md"


_FILE = pa.schema([("path", pa.string()), ("content", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("ctime", pa.timestamp("us", "UTC"))])


def _read_files(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for path in batch.column(0).slice(at, 256).to_pylist():
                    stat = os.stat(path)
                    born = getattr(stat, "st_birthtime", None)
                    with open(path, encoding="utf-8", newline="") as f:  # not UTF-8: the query fails
                        rows.append((os.path.relpath(path, root), f.read(), int(stat.st_mtime * 1e6), None if born is None else int(born * 1e6)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FILE)], schema=_FILE)

    return read


def read_folder(spark: SparkSession, root: str, folder: str = "", recursive: bool = False) -> DataFrame:
    """The texts of a folder that is mounted on all nodes; the files are listed and read by the tasks."""
    paths, n = listed(spark, resolve_folder(root, folder), recursive)
    parts = max(1, min(n // 500, spark.sparkContext.defaultParallelism * 4))
    return paths.repartition(parts).mapInArrow(_read_files(root), "path string, content string, mtime timestamp, ctime timestamp")


def notes(texts: DataFrame) -> DataFrame:
    """A notes DataFrame from ``texts`` (path, content; mtime and ctime if known).

    Notes whose frontmatter cannot be parsed are left out of every result.
    """
    return judged(named(texts))


def named(texts: DataFrame) -> DataFrame:
    """``texts`` with path_key and name, before anything is parsed or left out."""
    known = [c for c in ("mtime", "ctime") if c in texts.columns]
    return texts.select("path", F.split("path", "/").alias("path_key"), name_of(F.col("path")).alias("name"), "content", *known)


def judged(base: DataFrame) -> DataFrame:
    """The notes of ``named`` texts."""
    # Both steps stand in one projection, so that one Arrow exchange does for both, and either is dropped alone.
    read = base.select("*", parsed(F.col("content")).alias("_parsed"), invalid(F.col("content")).alias("_invalid"))
    return read.filter(~F.col("_invalid")).select(*base.columns, "_parsed.status", "_parsed.body_length", "_parsed.fields")
