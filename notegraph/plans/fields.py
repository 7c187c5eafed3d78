"""From field names to columns: virtual fields, graph fields, frontmatter, typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import percent_decoded
from .values import Value, absent, from_cell, from_column

#: Fields that need the link graph.
GRAPH_FIELDS = ("_links", "_link_count", "_backlinks", "_backlink_count")
VIRTUAL_FIELDS = ("_name", "_path", "_folder", "_modified", "_created", "_length", "_body_length", *GRAPH_FIELDS)

_TEXT, _LONG, _TEXTS = T.StringType(), T.LongType(), T.ArrayType(T.StringType())


def name_of(path: Column) -> Column:
    """A note's name: the file stem, percent-decoded."""
    return percent_decoded(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", ""))


def folder_of(path: Column, root_name: str) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit(root_name))


class NoteFields:
    """Fields of a notes DataFrame.  Graph fields resolve only if their columns were attached."""

    def __init__(self, df: DataFrame, root_name: str = ""):
        self.columns, self.root_name = set(df.columns), root_name

    def __call__(self, field: str) -> Value:
        c = F.col
        if field == "_name":
            return from_column(c("name"), _TEXT, False)
        if field == "_path":
            return from_column(c("path"), _TEXT, False)
        if field == "_folder":
            return from_column(folder_of(c("path"), self.root_name), _TEXT, False)
        if field in ("_modified", "_created"):
            stamp = "mtime" if field == "_modified" else "ctime"
            return from_column(F.date_format(stamp, "yyyy-MM-dd HH:mm"), _TEXT, False) if stamp in self.columns else absent()
        if field == "_length":
            return from_column(F.octet_length("content").cast("long"), _LONG, False)
        if field == "_body_length":
            return from_column(c("body_length"), _LONG, False)
        if field in GRAPH_FIELDS:
            if field not in self.columns:
                return absent()
            return from_column(c(field), _LONG if field.endswith("count") else _TEXTS, False)
        return from_cell(c("fields")[field])


class TableFields:
    """Fields of any DataFrame: its columns, with ``_name`` as an alias of one of them."""

    def __init__(self, df: DataFrame, name: str | None = None, null_is_present: bool = True):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.name, self.null_is_present = name, null_is_present

    def __call__(self, field: str) -> Value:
        if field == "_name" and self.name:
            field = self.name
        if field not in self.types:
            return absent()
        return from_column(F.col(f"`{field}`"), self.types[field], self.null_is_present)
