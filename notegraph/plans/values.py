"""What a field is to an operator: a handful of columns, from notes or from typed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import float_text_column, number_of

ITEM_TYPE = "array<struct<type: string, disp: string>>"


@dataclass(frozen=True)
class Value:
    """Columns of one field.  ``kind`` is null where the field is absent.

    ``native`` and ``static`` are set where the field is a typed column that is only
    absent or null where the column is null; comparisons then keep to that column.
    """

    kind: Column
    text: Column
    number: Column
    items: Column
    json: Column
    native: Column | None = None
    static: str | None = None

    @property
    def present(self) -> Column:
        return self.native.isNotNull() if self.native is not None else F.coalesce(self.kind != "null", F.lit(False))

    @property
    def cell(self) -> Column:
        return F.when(self.kind.isNotNull(), F.struct(self.kind.alias("type"), self.text.alias("disp"), self.number.alias("num"), self.items.alias("items"), self.json.alias("json")))


def from_cell(cell: Column) -> Value:
    return Value(cell["type"], cell["disp"], cell["num"], cell["items"], cell["json"])


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def from_column(column: Column, kind: T.DataType, null_is_present: bool = True) -> Value:
    """A typed column as a field; null counts as a null value, or as absent."""
    missing = F.lit("null") if null_is_present else _nothing("string")
    named = lambda name: F.when(column.isNull(), missing).otherwise(F.lit(name))
    json = F.when(column.isNotNull(), F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"}))
    json = F.coalesce(F.regexp_replace(json, r'(?s)^\{"v":(.*)\}$', "$1"), F.lit("null"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Value(named("integer"), F.coalesce(column.cast("string"), F.lit("")), column.cast("double"), _nothing(ITEM_TYPE), json, column, "integer")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Value(named("float"), F.coalesce(float_text_column(column.cast("double")), F.lit("")), column.cast("double"), _nothing(ITEM_TYPE), json, column, "float")
    if isinstance(kind, T.DecimalType):
        return Value(named("float"), F.coalesce(float_text_column(column.cast("double")), F.lit("")), column.cast("double"), _nothing(ITEM_TYPE), json, column, "float")
    if isinstance(kind, T.BooleanType):
        return Value(named("bool"), F.coalesce(column.cast("string"), F.lit("")), _nothing("double"), _nothing(ITEM_TYPE), json, column, "bool")
    if isinstance(kind, T.ArrayType):
        element = lambda x: from_column(x, kind.elementType)
        items = F.transform(column, lambda x: F.struct(element(x).kind.alias("type"), element(x).text.alias("disp")))
        return Value(named("list"), F.coalesce(F.array_join(items["disp"], ", "), F.lit("")), _nothing("double"), items, json, column, "list")
    if isinstance(kind, (T.MapType, T.StructType)):
        return Value(named("map"), json, _nothing("double"), _nothing(ITEM_TYPE), json, column, "map")
    text = column.cast("string")
    return Value(named("string"), F.coalesce(text, F.lit("")), number_of(text), _nothing(ITEM_TYPE), json, text, "string")


def absent() -> Value:
    return Value(_nothing("string"), _nothing("string"), _nothing("double"), _nothing(ITEM_TYPE), _nothing("string"))
