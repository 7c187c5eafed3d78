"""Structured Streaming over tables of note texts.

The predicates and fields are those of the batch engine; only operators that need the
whole vault at once (the link graph) stay with batch queries.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidPredicate
from ..operators.records import Records, fields_in
from ..plans.fields import GRAPH_FIELDS, NoteFields
from ..session import ship
from ..sources.notes import notes

TEXTS = "path string, content string, mtime timestamp"


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of (path, content, mtime) from Parquet files that are added to a folder."""
    reader = ship(spark).readStream.schema(TEXTS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def matching(texts: DataFrame, where: Iterable[str]) -> Records:
    """The arriving notes for which all clauses hold."""
    where = list(where)
    if used := fields_in(*where) & set(GRAPH_FIELDS):
        raise InvalidPredicate(f"a stream has no link fields: {', '.join(sorted(used))}")
    df = notes(texts)
    return Records(df, NoteFields(df), ("path_key",)).where(*where)


def tag_counts(texts: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, tag, n by modification time; a window closes once ``late`` has passed."""
    timed = notes(texts.withWatermark("mtime", late))
    items = timed.select("mtime", F.col("fields")["tags"].alias("cell")).filter("cell.type = 'list'").select("mtime", F.explode("cell.items").alias("item")).filter("item.type = 'string'")
    counted = items.groupBy(F.window("mtime", window).alias("w"), F.col("item.disp").alias("tag")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "tag", "n")
