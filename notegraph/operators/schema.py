"""Collections with a schema: loading, showing, validation, inference."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions.frontmatter import read_yaml
from ..functions.values import display, float_text_column
from .records import Records

#: Declared types and the value types they take; any other declared type takes all.
TAKES = {"string": ("string",), "integer": ("integer",), "float": ("float", "integer"), "number": ("integer", "float"), "bool": ("bool",), "list": ("list",), "map": ("map",)}


@dataclass
class FieldRule:
    type: str
    enum: list[object] = field(default_factory=list)
    min: float | None = None
    max: float | None = None
    required: bool | None = None  # part of the format; only a collection's list is enforced


@dataclass
class Collection:
    folder: str
    description: str | None = None
    filter: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    fields: dict[str, FieldRule] = field(default_factory=dict)


def load(text: str) -> dict[str, Collection]:
    """Collections by name from a YAML document."""
    try:
        document = read_yaml(text)
        out = {}
        for name, c in document["collections"].items():
            rules = {k: FieldRule(v["type"], v.get("enum") or [], v.get("min"), v.get("max"), v.get("required")) for k, v in (c.get("fields") or {}).items()}
            out[name] = Collection(c["folder"], c.get("description"), c.get("filter") or [], c.get("required") or [], rules)
        return dict(sorted(out.items()))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise SchemaError(f"not a schema: {e}") from e


def load_file(path: str) -> dict[str, Collection]:
    try:
        with open(path, encoding="utf-8") as f:
            return load(f.read())
    except OSError as e:
        raise SchemaError(f"cannot read {path}") from e


def for_folder(collections: dict[str, Collection], folder: str) -> dict[str, Collection]:
    """Collections of the folder itself and of folders below it."""
    return {k: c for k, c in collections.items() if c.folder == folder or c.folder.startswith(f"{folder}/")}


def show(spark: SparkSession, collections: dict[str, Collection]) -> DataFrame:
    """One row for each declared field (or one for a collection without any)."""
    rows = [
        (name, c.description, c.folder, c.filter, c.required, f, r.type if r else None, [display(x) for x in r.enum] if r else None, r.min if r else None, r.max if r else None)
        for name, c in collections.items()
        for f, r in (sorted(c.fields.items()) or [(None, None)])
    ]
    ddl = "collection string, description string, folder string, filter array<string>, required array<string>, field string, type string, enum array<string>, min double, max double"
    return spark.createDataFrame([(*r[:8], *(None if x is None else float(x) for x in r[8:])) for r in rows], ddl)


def _violation(name: str, message: Column, broken: Column) -> Column:
    return F.when(broken, F.struct(F.lit(name).alias("field"), message.alias("message")))


def validate(records: Records, collection: Collection) -> DataFrame:
    """file, field, message: all violations of a collection, by file, required fields first.

    All checks are expressions of one pass over the records; only frontmatter counts.
    """
    checked = records.where(*collection.filter)
    checks: list[Column] = []
    cell = lambda name: F.col("fields")[name]
    for name in collection.required:
        checks.append(_violation(name, F.lit("required field is missing or null"), ~F.coalesce(cell(name)["type"] != "null", F.lit(False))))
    for name, rule in sorted(collection.fields.items()):
        kind, text, number = cell(name)["type"], cell(name)["disp"], cell(name)["num"]
        present = F.coalesce(kind != "null", F.lit(False))
        if rule.type in TAKES:
            checks.append(_violation(name, F.concat(F.lit(f"expected type '{rule.type}', got '"), kind, F.lit("'")), present & ~kind.isin(*TAKES[rule.type])))
        if rule.enum:
            # A float member's text keeps its ".0"; truth values and null never match.
            members = [x if isinstance(x, str) else repr(x) for x in rule.enum if isinstance(x, (str, int, float)) and not isinstance(x, bool)]
            shown = ", ".join(f'"{display(x) if x is not None else "null"}"' for x in rule.enum)
            checks.append(_violation(name, F.concat(F.lit("value '"), text, F.lit(f"' not in allowed values: [{shown}]")), present & ~(text.isin(*members) if members else F.lit(False))))
        for bound, word, broken in ((rule.min, "is below minimum", number < F.lit(rule.min)), (rule.max, "exceeds maximum", (number > F.lit(rule.max)) & ~F.isnan(number))):
            if bound is not None:
                message = F.concat(F.lit("value "), float_text_column(number), F.lit(f" {word} {display(float(bound))}"))
                checks.append(_violation(name, message, present & broken))
    if not checks:
        return checked.df.select(F.col("name").alias("file"), F.lit("").alias("field"), F.lit("").alias("message")).limit(0)
    found = checked.df.select(F.col("name").alias("file"), *checked.order, F.posexplode(F.filter(F.array(*checks), lambda v: v.isNotNull())).alias("nth", "v"))
    return found.orderBy(*checked.order, "nth").select("file", "v.field", "v.message")


def infer(records: Records) -> DataFrame:
    """field, type, required, enum (null if none) for every frontmatter field.

    The type is the most frequent one but null (ties: the last by name), ``string`` if
    all are null.  A field is required if every record has it non-null.  At most 10
    values, under half as many as there are scalars, make an enum; only 11 distinct
    values of a field are ever gathered.
    """
    counts = records.counted_entries()
    total = counts.filter("field is null").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    entries = counts.filter("field is not null")
    by_type = entries.groupBy("field", "type").agg(F.sum("n").alias("n"))
    types = by_type.groupBy("field").agg(
        F.coalesce(F.max_by(F.when(F.col("type") != "null", F.col("type")), F.when(F.col("type") != "null", F.struct("n", "type"))), F.lit("string")).alias("type"),
        F.coalesce(F.sum(F.when(F.col("type") != "null", F.col("n"))), F.lit(0)).alias("non_null"),
    )
    values = entries.filter(~F.col("type").isin("null", "list", "map")).groupBy("field", "disp").agg(F.sum("n").alias("n"))
    counted = values.groupBy("field").agg(F.count("*").alias("distinct"), F.sum("n").alias("scalars"))
    few = counted.filter((F.col("distinct") <= 10) & (F.col("distinct") < F.floor(F.col("scalars") / 2))).select("field")
    enums = values.join(few, "field").groupBy("field").agg(F.array_sort(F.collect_list("disp")).alias("enum"))
    return types.join(enums, "field", "left").select("field", "type", (F.col("non_null") == total).alias("required"), "enum").orderBy("field")


def infer_collection(records: Records, folder: str) -> Collection:
    """The inferred schema of a folder as a collection; as many rows as there are fields reach the driver."""
    rows = infer(records).collect()
    member = lambda text: int(text) if text.lstrip("+-").isdecimal() and text.isascii() and text.count("+") + text.count("-") <= 1 and -(1 << 63) <= int(text) < 1 << 63 else text
    return Collection(folder, f"Auto-inferred schema for {folder}", [], [r["field"] for r in rows if r["required"]], {r["field"]: FieldRule(r["type"], [member(x) for x in r["enum"] or []]) for r in rows})


def dump(collections: dict[str, Collection]) -> str:
    """Collections as a YAML document that ``load`` reads."""
    import yaml

    document = {}
    for name, c in collections.items():
        entry: dict[str, object] = {"description": c.description} if c.description is not None else {}
        entry["folder"] = c.folder
        entry |= {k: v for k, v in (("filter", c.filter), ("required", c.required)) if v}
        if c.fields:
            entry["fields"] = {k: {"type": r.type} | {n: v for n, v in (("enum", r.enum), ("min", r.min), ("max", r.max), ("required", r.required)) if v not in (None, [])} for k, r in c.fields.items()}
        document[name] = entry
    return yaml.safe_dump({"collections": document}, sort_keys=False, allow_unicode=True)
