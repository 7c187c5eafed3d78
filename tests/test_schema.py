"""Schemas: loading, validation, inference."""

import pytest

from notegraph.errors import NoteError, SchemaError
from notegraph.operators import schema
from notegraph.vault import Notes, Vault

DOC = """
collections:
  movies:
    folder: movies
    filter: ["status exists || year exists"]
    required: [status, year]
    fields:
      status: {type: string, enum: [seen, to-watch]}
      year: {type: integer, min: 1900, max: 2030}
      rating: {type: number, enum: [8.0, 9, true, null]}
      odd: {type: whatever}
      flag: {type: bool}
  below:
    folder: movies/old
"""


def notes(spark, files):
    return Notes.of_texts(spark.createDataFrame([(f"movies/{k}.md", f"---\n{v}\n---\n") for k, v in files.items()], "path string, content string"))


def test_load_and_choose():
    loaded = schema.load(DOC)
    assert list(schema.for_folder(loaded, "movies")) == ["below", "movies"] and list(schema.for_folder(loaded, "mov")) == []
    for bad in ("x: 1", "collections: {a: {}}", "- a", "collections:\n  a:\n    folder: f\n    fields: {x: {}}"):
        with pytest.raises(SchemaError):
            schema.load(bad)
    with pytest.raises(SchemaError):
        schema.load_file("/nonexistent/schema.yaml")


def test_validate(spark):
    n = notes(
        spark,
        {
            "a": "status: seen\nyear: 1999\nrating: 9\nodd: [1]\nflag: true",
            "b": "status: lost\nyear: '1800'",
            "c": "year: 2040.5\nrating: 8.0\nflag: 1",
            "d": "status: null\nyear: nan",
            "e": "other: 1",
        },
    )
    got = [tuple(r) for r in n.validate(schema.load(DOC)["movies"]).collect()]
    assert got == [
        ("b", "status", "value 'lost' not in allowed values: [\"seen\", \"to-watch\"]"),
        ("b", "year", "expected type 'integer', got 'string'"),
        ("b", "year", "value 1800 is below minimum 1900"),
        ("c", "status", "required field is missing or null"),
        ("c", "flag", "expected type 'bool', got 'integer'"),
        ("c", "rating", "value '8' not in allowed values: [\"8\", \"9\", \"true\", \"null\"]"),
        ("c", "year", "expected type 'integer', got 'float'"),
        ("c", "year", "value 2040.5 exceeds maximum 2030"),
        ("d", "status", "required field is missing or null"),
        ("d", "year", "expected type 'integer', got 'string'"),
    ]
    assert n.validate(schema.load(DOC)["below"]).collect() == []
    with pytest.raises(NoteError):
        n.validate(schema.Collection("movies", filter=["_link_count = 0"]))


def test_infer(spark):
    n = notes(spark, {f"n{i}": f"status: {'a' if i % 2 else 'b'}\nyear: {1990 + i}\nmixed: {i if i < 3 else 'x'}\nnone:\nhsk: {i % 2}" + ("\nsome: 1" if i else "") for i in range(6)})
    got = {r["field"]: (r["type"], r["required"], r["enum"]) for r in n.infer_schema().collect()}
    assert got == {"status": ("string", True, ["a", "b"]), "year": ("integer", True, None), "mixed": ("string", True, None), "none": ("string", False, None), "some": ("integer", False, ["1"]), "hsk": ("integer", True, ["0", "1"])}
    collection = schema.infer_collection(n.records(), "movies")
    assert collection.fields["hsk"].enum == [0, 1] and collection.fields["status"].enum == ["a", "b"]
    again = schema.load(schema.dump({"movies": collection}))["movies"]
    assert again.fields == collection.fields and again.required == collection.required


def test_vault_commands(spark, tmp_path):
    (tmp_path / "movies").mkdir()
    (tmp_path / "movies/a.md").write_text("---\nyear: 1999\n---\n")
    vault = Vault(spark, str(tmp_path))
    with pytest.raises(SchemaError):
        vault.schema_show("movies")
    (tmp_path / "schema.yaml").write_text(DOC)
    shown = vault.schema_show("movies").collect()
    assert {(r["collection"], r["field"], r["type"]) for r in shown} >= {("movies", "year", "integer"), ("below", None, None)}
    assert [tuple(r) for r in vault.schema_validate("movies").collect()] == [("movies", "a", "status", "required field is missing or null")]
    assert vault.schema_validate("elsewhere").collect() == []
    assert "year:\n" in vault.schema_init("movies")
