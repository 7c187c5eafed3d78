"""Applying plans of changes to the files of a mounted folder, in the tasks.

Each function works through a written plan, so a change of the files cannot change it.
A task that is run again, after its executor was lost, finds its earlier changes made and
leaves them: texts are replaced by the same texts, files that are gone from the old place
were moved.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _each(plan: DataFrame, columns: tuple[str, ...], change: Callable[..., bool]) -> DataFrame:
    """path of the rows for which ``change`` of the columns is true, which it is called for in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows if change(*r)], pa.string())], ["path"])

    return plan.select(*columns).mapInArrow(run, "path string")


def replace_text(path: str, text: str) -> None:
    """Replace a file at once: readers see the old text or the new one."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"  # two runs of one task don't share it
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(part, path)


def _unless_gone(change: Callable[..., None], path: str, *to: str) -> None:
    """The change of a file, unless an earlier or parallel run of the task has made it."""
    try:
        change(path, *to)
    except FileNotFoundError:
        if os.path.exists(path):
            raise


def write_texts(plan: DataFrame, root: str) -> int:
    """Write ``new_content`` of each row of ``plan`` (path, new_content); the number of files."""

    def write(path: str, text: str) -> bool:
        replace_text(os.path.join(root, path), text)
        return True

    return _each(plan, ("path", "new_content"), write).count()


def taken(plan: DataFrame, root: str) -> DataFrame:
    """path of the rows of ``plan`` (path, new_path) whose new place holds a file."""
    return _each(plan, ("path", "new_path"), lambda _, new: os.path.exists(os.path.join(root, new)))


def move_files(plan: DataFrame, root: str) -> int:
    """Move the files of ``plan`` (path, new_path); the number of files."""

    def move(old: str, new: str) -> bool:
        _unless_gone(os.rename, os.path.join(root, old), os.path.join(root, new))
        return True

    return _each(plan, ("path", "new_path"), move).count()


def remove_files(plan: DataFrame, root: str) -> int:
    def remove(path: str, _: str) -> bool:
        _unless_gone(os.remove, os.path.join(root, path))
        return True

    return _each(plan, ("path", "name"), remove).count()


def trash_files(plan: DataFrame, root: str, trash: str, stamp: int) -> int:
    """Move the files of ``plan`` (path, path_key) to the folder ``trash``; the number of files.

    The first of a name keeps it if it is free there; others get the stamp and a number.
    """
    from pyspark.sql import Window

    base = F.element_at("path_key", -1)
    nth = F.row_number().over(Window.partitionBy(base).orderBy("path_key")).cast("string")

    def discard(path: str, name: str, n: str) -> bool:
        if os.path.exists(source := os.path.join(root, path)):
            stem, ending = os.path.splitext(name)
            goal = os.path.join(root, trash, name)
            if n != "1" or os.path.exists(goal):
                goal = os.path.join(root, trash, f"{stem}.{stamp}{'' if n == '1' else '-' + n}{ending}")
            _unless_gone(os.rename, source, goal)
        return True

    return _each(plan.select("path", base.alias("base"), nth.alias("nth")), ("path", "base", "nth"), discard).count()
