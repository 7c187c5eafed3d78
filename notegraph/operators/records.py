"""Record sets: filter, select, sort, limit, count, field profile, tags.

``Records`` holds a DataFrame, a resolver from field names to columns, and the columns
of its natural order.  Every method builds a plan; only profiles, which read their counts
more than once, are written at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fields import TableFields
from ..plans.predicates import compile_clauses, fields_of, parse_clauses
from ..plans.values import Value
from ..session import materialise


@dataclass(frozen=True)
class Records:
    df: DataFrame
    resolve: Callable[[str], Value]
    order: tuple[str, ...]

    # -- filter ------------------------------------------------------------------

    def where(self, *clauses: str) -> Records:
        """Keep the records for which all clauses hold."""
        parsed = parse_clauses(list(clauses))
        return replace(self, df=self.df.filter(compile_clauses(parsed, self.resolve))) if parsed else self

    # -- order -------------------------------------------------------------------

    def sort_keys(self, field: str | None, descending: bool) -> list[Column]:
        """Absent, null, numbers, then other text; ties in the natural order.

        Descending reverses the whole order, ties and nulls too.
        """
        keys: list[Column] = []
        if field is not None:
            value = self.resolve(field)
            number, text = value.number, value.text
            if value.native is not None and value.static in ("integer", "float"):
                keys = [F.when(value.kind.isNull(), 0).when(value.native.isNull(), 1).otherwise(2), value.native]
            else:
                rank = F.when(value.kind.isNull(), 0).when(value.kind == "null", 1).when(number.isNotNull(), 2).otherwise(3)
                keys = [rank, number, F.when(number.isNull(), text)]
        keys += [F.col(c) for c in self.order]
        return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]

    def sorted(self, field: str | None = None, descending: bool = False, limit: int | None = None) -> Records:
        df = self.df.orderBy(*self.sort_keys(field, descending and field is not None))
        return replace(self, df=df if limit is None else df.limit(limit))

    # -- projection --------------------------------------------------------------

    def select(self, fields: str | Iterable[str], as_text: bool = False) -> DataFrame:
        """The fields as columns: typed where the type is known, display text otherwise; null if absent."""
        names = [f.strip() for f in fields.split(",")] if isinstance(fields, str) else list(fields)
        return self.df.select(*[self.column(n, as_text).alias(n) for n in names])

    def column(self, field: str, as_text: bool = False) -> Column:
        value = self.resolve(field)
        if value.native is not None and not as_text:
            return value.native
        return F.when(value.kind.isNotNull(), value.text)

    def cells(self, fields: Iterable[str]) -> DataFrame:
        """The fields as cell structs (type, disp, num, items, json); null if absent."""
        return self.df.select(*[self.resolve(f).cell.alias(f) for f in fields])

    def with_fields(self, **columns: str) -> DataFrame:
        """The natural order's columns and one display column for each keyword: name=field."""
        return self.df.select(*self.order, *[self.column(f).alias(n) for n, f in columns.items()])

    # -- aggregates --------------------------------------------------------------

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def counted_entries(self) -> DataFrame:
        """field, type, disp, n: how often each value stands, written once; one parse for all that is read from it.

        ``disp`` is null for lists and maps.  The row whose field is null counts the records.
        """
        entry = lambda field, kind, disp: F.struct(field.alias("field"), kind.alias("type"), disp.alias("disp"))
        none = F.lit(None).cast("string")
        each = F.transform(F.map_entries("fields"), lambda e: entry(e["key"], e["value"]["type"], F.when(~e["value"]["type"].isin("list", "map"), e["value"]["disp"])))
        entries = self.df.select(F.explode(F.concat(each, F.array(entry(none, none, none)))).alias("e")).select("e.*")
        return materialise(entries.groupBy("field", "type", "disp").agg(F.count("*").alias("n")), "entries")

    def field_profile(self) -> DataFrame:
        """field, types (sorted, joined), non_null, present, coverage in whole percent (half to even)."""
        entry = lambda field, kind: F.struct(field.alias("field"), kind.alias("type"))
        none = F.lit(None).cast("string")
        each = F.transform(F.map_entries("fields"), lambda e: entry(e["key"], e["value"]["type"]))
        by_type = materialise(self.df.select(F.explode(F.concat(each, F.array(entry(none, none)))).alias("e")).groupBy("e.field", "e.type").agg(F.count("*").alias("n")), "types")
        total = by_type.filter("field is null").agg(F.sum("n")).scalar()
        by_field = by_type.filter("field is not null").groupBy("field").agg(
            F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"), F.coalesce(F.sum(F.when(F.col("type") != "null", F.col("n"))), F.lit(0).cast("long")).alias("non_null"), F.sum("n").alias("present")
        )
        return by_field.select("field", "types", "non_null", "present", F.bround(F.col("present") / total * 100, 0).cast("int").alias("coverage"))

    def tags(self, field: str = "tags") -> DataFrame:
        """tag, n: text items of list-valued ``field``, most frequent first."""
        items = self.df.select(F.col("fields")[field].alias("cell")).filter("cell.type = 'list'").select(F.explode("cell.items").alias("item")).filter("item.type = 'string'")
        return items.groupBy(F.col("item.disp").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")

    def field_names(self) -> DataFrame:
        """The keys that any record has, sorted: the columns shown when none are selected."""
        return self.df.select(F.explode(F.map_keys("fields")).alias("field")).distinct().orderBy("field")


def from_table(df: DataFrame, name: str | None = None, order: Iterable[str] = ()) -> Records:
    """Records over any typed DataFrame; predicates become plain comparisons that reach the scan."""
    return Records(df, TableFields(df, name), tuple(order))


def fields_in(*clauses: str) -> set[str]:
    """The fields that clauses name."""
    return fields_of(parse_clauses(list(clauses)))
