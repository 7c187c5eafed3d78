"""Bulk changes as plans: a DataFrame of what would change, applied only on request.

Edits of texts are an Arrow step over the matching notes; renames, moves and deletes
are joins over paths and links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EditError, InvalidPredicate, SafetyRefused
from ..functions.editing import Edit, apply_edits
from ..plans.fields import GRAPH_FIELDS
from ..session import materialise
from .graph import Graph
from .records import Records, fields_in


def guarded(records: Records, where: Iterable[str], action: str) -> Records:
    """Matching records; at least one condition is needed, and graph fields are refused."""
    where = list(where)
    if not where:
        raise SafetyRefused(f"{action} needs at least one condition")
    if used := fields_in(*where) & set(GRAPH_FIELDS):
        raise InvalidPredicate(f"{action} cannot use link fields: {', '.join(sorted(used))}")
    return records.where(*where)


def edits_of(set: Iterable[str] = (), unset: Iterable[str] = (), add_tag: Iterable[str] = (), remove_tag: Iterable[str] = ()) -> list[Edit]:
    """Edits in their fixed order: set (``FIELD=VALUE``), unset, add, remove."""
    edits = []
    for text in set:
        key, equals, value = text.partition("=")
        if not equals:
            raise EditError(f"FIELD=VALUE expected, got: {text}")
        edits.append(Edit("set", key.strip(), value.strip()))
    edits += [Edit(kind, x.strip()) for kind, names in (("unset", unset), ("add_tag", add_tag), ("remove_tag", remove_tag)) for x in names]
    if not edits:
        raise EditError("no edit given")
    return edits


def update_plan(matching: Records, edits: list[Edit]) -> DataFrame:
    """path, name, new_content, changes, error for each matching note."""

    @F.arrow_udf("new_content string, changes array<string>, error string")
    def edit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            new, changes, errors = [], [], []
            for text in batch.to_pylist():
                try:
                    result, error = apply_edits(text or "", edits), None
                except EditError as e:
                    result, error = (None, []), str(e)
                new.append(result[0])
                changes.append(result[1])
                errors.append(error)
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(changes, pa.list_(pa.string())), pa.array(errors, pa.string())], ["new_content", "changes", "error"])

    planned = matching.df.select("path", "path_key", "name", "content").withColumn("e", edit.asNondeterministic()(F.col("content")))
    return planned.select("path", "path_key", "name", "e.new_content", "e.changes", "e.error")


def rename_plan(graph: Graph, old: str, new: str) -> DataFrame:
    """path, name, links, new_content of each note that links to ``old`` in a form that can be rewritten.

    Of referrers that share a name the first path is rewritten; ``[[old]]``, ``[[old|``
    and ``[[old#`` are replaced, also inside code.
    """
    referrers = graph.incoming.filter(F.col("dst") == old).select(F.col("src").alias("name"))
    first = graph.notes.join(referrers, "name", "left_semi").groupBy("name").agg(F.min_by(F.struct("path", "content"), "path_key").alias("note")).select("name", "note.path", "note.content")
    count, text = F.lit(0), F.col("content")
    for mark in ("]]", "|", "#"):
        before, after = f"[[{old}{mark}", f"[[{new}{mark}"
        count = count + ((F.length(text) - F.length(F.replace(text, F.lit(before), F.lit("")))) / F.lit(len(before))).cast("int")
        text = F.replace(text, F.lit(before), F.lit(after))
    return first.select("path", "name", count.alias("links"), text.alias("new_content")).filter("links > 0")


def move_plan(matching: Records, everything: DataFrame, target: str) -> DataFrame:
    """path, new_path, conflict: whether the target is taken, by a note or by another moved one."""
    target = target.strip("/")
    base = F.element_at(F.col("path_key"), -1)
    moved = materialise(matching.df.select("path", "path_key", F.concat(F.lit(f"{target}/" if target else ""), base).alias("new_path")), "moved")
    taken = everything.select(F.col("path").alias("new_path"), F.lit(True).alias("taken")).distinct()
    twice = moved.groupBy("new_path").agg((F.count("*") > 1).alias("twice"))
    return moved.join(taken, "new_path", "left").join(twice, "new_path").select("path", "path_key", "new_path", (F.coalesce("taken", F.lit(False)) | F.col("twice")).alias("conflict"))


def delete_plan(matching: Records, graph: Graph) -> DataFrame:
    """path, name, dangling: how many notes of the whole vault link to each deleted name.

    The matching notes are written first, so that of all links only those to them are grouped.
    """
    doomed = materialise(matching.df.select("path", "path_key", "name"), "doomed")
    links = graph.incoming.join(doomed.select(F.col("name").alias("dst")), "dst", "left_semi").groupBy("dst").agg(F.count("*").alias("dangling")).withColumnRenamed("dst", "name")
    return doomed.join(links, "name", "left").select("path", "path_key", "name", F.coalesce("dangling", F.lit(0).cast("long")).alias("dangling"))
