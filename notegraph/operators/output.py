"""Records as text: table, JSON, YAML or CSV.

The columns that write one record each are Spark expressions, so a result of any size
can be written by ``df.write.text``; ``render`` joins them for a console.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import Records

WIDTH = 60


def shortened(text: Column, width: int = WIDTH) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(text)


def shown_fields(records: Records, select: list[str] | None) -> list[str]:
    """The selected fields, or the name and then all keys, sorted."""
    return select or ["_name", *[r[0] for r in records.field_names().collect()]]


def json_lines(records: Records, fields: list[str]) -> Column:
    """One JSON object, keys in alphabetical order, absent fields as null."""
    quote = lambda name: F.regexp_replace(F.to_json(F.array(F.lit(name))), r"^\[|\]$", "")
    pairs = [F.concat(quote(f), F.lit(":"), F.coalesce(records.resolve(f).json, F.lit("null"))) for f in sorted(set(fields))]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def yaml_text(records: Records, fields: list[str]) -> Column:
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(records.resolve(f).text, F.lit("")), F.lit("\n")) for f in fields]
    return F.concat(F.lit("---\n"), *lines)


def csv_line(records: Records, fields: list[str]) -> Column:
    def cell(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return F.when(text.rlike('[",\r\n]') | ((text == "") & F.lit(len(fields) == 1)), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[cell(records.resolve(f).text) for f in fields])


def table_cells(records: Records, fields: list[str]) -> list[Column]:
    return [shortened(F.coalesce(records.resolve(f).text, F.lit(""))).alias(f"c{i}") for i, f in enumerate(fields)]


def lines(records: Records, fields: list[str], form: str) -> DataFrame:
    """One row ``value`` for each record in form json, yaml or csv (without header), in order."""
    column = {"json": json_lines, "yaml": yaml_text, "csv": csv_line}[form](records, fields)
    return records.df.select(column.alias("value"))


def render(records: Records, select: list[str] | None = None, form: str = "table") -> str:
    """The text that a console shows; all of it goes to the driver."""
    import json

    fields = shown_fields(records, select)
    if form == "table":
        rows = [fields, *[list(map(str, r)) for r in records.df.select(*table_cells(records, fields)).collect()]]
        widths = [max(len(r[i]) for r in rows) for i in range(len(fields))]
        text = [" | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows]
        return "\n".join([text[0], "-+-".join("-" * w for w in widths), *text[1:]])
    found = [r[0] for r in lines(records, fields, form).collect()]
    if form == "json":
        return json.dumps([json.loads(x) for x in found], ensure_ascii=False, indent=2)
    if form == "yaml":
        return "".join(found)
    header = ",".join('"' + f.replace('"', '""') + '"' if set(f) & set('",\r\n') else f for f in fields)
    return "\n".join([header, *found]) + "\n"
