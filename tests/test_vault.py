"""Vaults in folders: listing, virtual fields, queries, changes."""

import os

import pytest
from pyspark.sql import functions as F

from notegraph.errors import EditError, FolderNotFound, InvalidPredicate, NoteError, SafetyRefused, VaultNotFound
from notegraph.operators import apply
from notegraph.session import materialise
from notegraph.sources import notes as sources
from notegraph.sources.notes import discover, list_notes
from notegraph.vault import Vault


def write(root, files):
    for path, text in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def root(tmp_path):
    (tmp_path / ".obsidian").mkdir()
    write(
        tmp_path,
        {
            "notes/one.md": "---\ntags:\n  - a\nstatus: active\nyear: 1917\n---\nSee [[two]] and [[dir/three|x]].\n",
            "notes/two.md": "---\nstatus: draft\nyear: null\n---\n`[[not]]` [[one#part]] [[gone]]\n",
            "notes/plain.md": "no frontmatter [[one]]\n",
            "notes/broken.md": "---\na: [1\n---\n[[one]]",
            "notes/twice.md": "---\na: 1\na: 2\n---\n",
            "notes/_under.md": "---\nstatus: active\n---\n",
            "notes/.dot.md": "---\nstatus: active\n---\n",
            "notes/readme.txt": "no note",
            "notes/sub/three.md": "---\nstatus: active\n---\n",
            "notes/.hidden/x.md": "---\nstatus: active\n---\n",
            "notes/100%25%C3%A9%zz.md": "---\nstatus: odd\n---\n",
        },
    )
    return tmp_path


def names(records):
    return [r["name"] for r in records.df.select("name").collect()]


def test_discovery_and_listing(root, tmp_path_factory):
    assert discover(str(root / "notes" / "sub")) == str(root)
    with pytest.raises(VaultNotFound):
        discover(str(tmp_path_factory.mktemp("none")))
    flat = [os.path.basename(p) for p in list_notes(str(root / "notes"), False)]
    assert ".dot.md" in flat and "_under.md" in flat and "readme.txt" not in flat and len(flat) == 8
    deep = [os.path.relpath(p, root) for p in list_notes(str(root / "notes"), True)]
    assert "notes/sub/three.md" in deep and "notes/.dot.md" not in deep and "notes/.hidden/x.md" not in deep
    assert list_notes(str(root / "notes" / ".hidden"), True) == [] and len(list_notes(str(root / "notes" / ".hidden"), False)) == 1


@pytest.mark.parametrize("folders_a_task", [1, 2, 1000])
def test_tasks_list_the_same_files(spark, root, monkeypatch, folders_a_task):
    monkeypatch.setattr(sources, "FOLDERS_A_TASK", folders_a_task)
    write(root, {f"deep/{i % 3}/{i % 5}/x{i}.md": "" for i in range(40)})
    os.symlink(root / "deep", root / "loop")
    os.symlink(root / "notes/one.md", root / "deep/0/alias.md")
    for folder in ("", "notes", "deep", "deep/0", "notes/.hidden"):
        for recursive in (False, True):
            path = os.path.join(root, folder)
            found, n = sources.listed(spark, path, recursive)
            assert sorted(r[0] for r in found.collect()) == list_notes(path, recursive) and n == found.count()


def test_applied_changes_can_be_run_again(spark, root):
    """As a task that is retried does: nothing is lost and nothing fails."""
    plan = materialise(spark.createDataFrame([("notes/one.md", "one", "new text", "done/one.md"), ("notes/two.md", "two", "2", "done/two.md")], "path string, name string, new_content string, new_path string").withColumn("path_key", F.split("path", "/")), "plan")
    for _ in range(2):
        assert apply.write_texts(plan, str(root)) == 2
    assert (root / "notes/one.md").read_text() == "new text" and apply.taken(plan, str(root)).collect() == []
    os.makedirs(root / "done")
    for _ in range(2):
        assert apply.move_files(plan, str(root)) == 2
    assert (root / "done/two.md").read_text() == "2" and not (root / "notes/two.md").exists() and apply.taken(plan, str(root)).count() == 2
    there = plan.withColumn("path", F.col("new_path"))
    write(root, {"a/same.md": "a", "b/same.md": "b", "c/same.md": "c", ".trash/one.md": "old"})
    same = spark.createDataFrame([(f"{x}/same.md", "same") for x in "abc"], "path string, name string").withColumn("path_key", F.split("path", "/"))
    for _ in range(2):
        assert apply.trash_files(there.select("path", "name", "path_key").union(same), str(root), ".trash", 77) == 5
    assert {p: (root / ".trash" / p).read_text() for p in os.listdir(root / ".trash")} == {"one.md": "old", "one.77.md": "new text", "two.md": "2", "same.md": "a", "same.77-2.md": "b", "same.77-3.md": "c"}
    for _ in range(2):
        assert apply.remove_files(plan.withColumn("path", F.lit("notes/plain.md")), str(root)) == 2
    assert not (root / "notes/plain.md").exists()


def test_records_and_virtual_fields(spark, root):
    vault = Vault(spark, str(root))
    notes = vault.notes("notes")
    assert names(notes.query()) == [".dot", "100%é%zz".replace("é", "Ã©"), "_under", "one", "plain", "two"]
    assert names(notes.query(["status = active"])) == [".dot", "_under", "one"]
    assert names(notes.query(["year = 1917.0"])) == ["one"] and names(notes.query(["year missing", "status exists"])) == [".dot", "100%Ã©%zz", "_under", "two"]
    row = notes.query(["_name = one"]).select("_path, _folder, _length, _body_length, _modified, _created, nothing").collect()[0]
    size = (root / "notes/one.md").stat().st_size
    assert row[:4] == ("notes/one.md", "notes", size, 32) and len(row[4]) == 16 and row[6] is None
    with pytest.raises(FolderNotFound):
        vault.notes("absent")
    assert names(vault.notes("notes", True).query(["_folder = sub"])) == ["three"]


def test_verbose_rendering(spark, root, capsys):
    notes = Vault(spark, str(root)).notes("notes")
    assert notes.render(notes.query(["status = draft"]), "_name", "csv", verbose=True) == "_name\ntwo\n"
    assert capsys.readouterr().err == "1 record(s) matched\n"


def test_aggregates_and_rendering(spark, root):
    notes = Vault(spark, str(root)).notes("notes")
    assert notes.count(["status = active"]).first()[0] == 3
    profile = {r["field"]: tuple(r)[1:] for r in notes.fields_profile().collect()}
    assert profile == {"status": ("string", 5, 5, 83), "tags": ("list", 1, 1, 17), "year": ("integer, null", 1, 2, 33)}
    assert [tuple(r) for r in notes.tags().collect()] == [("a", 1)]
    found = notes.query(["_name startswith t || _name = one"], sort="year", desc=True)
    assert notes.render(found, "_name, year, tags", "csv") == "_name,year,tags\none,1917,a\ntwo,,\n"
    assert notes.render(found, "_name,year", "yaml") == "---\n_name: one\nyear: 1917\n---\n_name: two\nyear: \n"
    assert notes.render(found, "year,tags", "json") == '[\n  {\n    "tags": [\n      "a"\n    ],\n    "year": 1917\n  },\n  {\n    "tags": null,\n    "year": null\n  }\n]'
    assert notes.render(found).split("\n")[0] == "_name | status | tags | year"


def test_links_and_traversal(spark, root):
    notes = Vault(spark, str(root)).notes("notes", True)
    rows = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    assert sorted(rows(notes.links("two"), "direction", "other", "resolved")) == [("incoming", "one", True), ("outgoing", "gone", False), ("outgoing", "one", True)]
    # A path-qualified target is unresolved as an outgoing link, and still a backlink of the note.
    assert rows(notes.links("one", "outgoing"), "other", "resolved") in ([("dir/three", False), ("two", True)], [("two", True), ("dir/three", False)])
    assert rows(notes.links("three", "incoming"), "other") == [("one",)]
    assert names(notes.query(["_backlink_count = 0"])) == ["100%Ã©%zz", "_under", "plain"]
    assert rows(notes.unresolved(list_sources=True), "target", "n", "sources") == [("dir/three", 1, ["one"]), ("gone", 1, ["two"])]
    assert rows(notes.traverse("plain", 2), "name", "depth", "resolved") == [("plain", 0, True), ("one", 1, True), ("dir/three", 2, False), ("two", 2, True)]
    assert rows(notes.traverse("two", 1, "both"), "name", "depth") == [("two", 0), ("gone", 1), ("one", 1)]
    assert rows(notes.traverse("plain", 2, where=["status = draft"], select=["status"]), "name", "status") == [("two", "draft")]
    assert rows(notes.traverse("nobody", 2), "name") == []
    assert names(notes.query(links_to=["one"])) == ["plain", "two"] and names(notes.query(links_to=["dir/three"])) == ["one"] and names(notes.query(links_to=["three"])) == []
    assert names(notes.query(linked_from=["one"])) == ["three", "two"]
    assert names(notes.query(links_to_where=["year = 1917"])) == ["plain", "two"] and names(notes.query(linked_from_where=["_link_count = 2"])) == ["one", "three", "two"]


def test_update(spark, root):
    vault = Vault(spark, str(root))
    plan = vault.update("notes", ["status = draft"], set=["status = done"])
    assert [r["changes"] for r in plan.collect()] == [["set status = done (was: draft)"]] and "draft" in (root / "notes/two.md").read_text()
    vault.update("notes", ["status = draft"], set=["status = done"], apply=True)
    assert "status: done" in (root / "notes/two.md").read_text()
    before = (root / "notes/one.md").read_text()
    with pytest.raises(EditError):  # one refused edit: nothing is written
        vault.update("notes", ["status exists"], add_tag=["x"], apply=True)
    assert (root / "notes/one.md").read_text() == before
    with pytest.raises(SafetyRefused):
        vault.update("notes", [], set=["a=1"])
    with pytest.raises(InvalidPredicate):
        vault.update("notes", ["_backlink_count = 0"], set=["a=1"])
    with pytest.raises(EditError):
        vault.update("notes", ["status exists"])


def test_create_rename_move_delete(spark, root):
    vault = Vault(spark, str(root))
    assert vault.create("notes", "new", set=["status=x: y"], apply=True) == "---\nstatus: 'x: y'\n---\n\n# new\n"
    with pytest.raises(NoteError):
        vault.create("notes", "new")
    write(root, {"t.txt": "text\n"})
    assert vault.create("notes", "n2", template="t.txt", set=["a=1"]) == "---\na: 1\n---\ntext\n"

    vault.rename("one", "eins", "notes", apply=True)
    assert (root / "notes/eins.md").exists() and not (root / "notes/one.md").exists()
    assert "[[eins#part]]" in (root / "notes/two.md").read_text() and "[[eins]]" in (root / "notes/plain.md").read_text()

    plan = vault.move("notes", ["status = draft"], "done", apply=True).columns
    assert "conflict" in plan and (root / "done/two.md").exists()
    write(root, {"notes/two.md": "---\nstatus: draft\n---\n"})
    with pytest.raises(NoteError):
        vault.move("notes", ["status = draft"], "done", apply=True)

    write(root, {".trash/eins.md": "old"})
    rows = vault.delete("notes", ["_name = eins"], apply=False).collect()
    assert [(r["name"], r["dangling"]) for r in rows] == [("eins", 2)]
    vault.delete("notes", ["_name = eins"], apply=True)
    assert not (root / "notes/eins.md").exists() and len(os.listdir(root / ".trash")) == 2
    vault.delete("notes", ["_name = two"], force=True, apply=True)
    assert not (root / "notes/two.md").exists()


def test_note_that_links_to_itself_is_renamed_whole(spark, root):
    write(root, {"notes/self.md": "---\n---\n[[self]] [[self|me]]"})
    vault = Vault(spark, str(root))
    vault.rename("self", "me", "notes", apply=True)
    assert (root / "notes/me.md").read_text() == "---\n---\n[[me]] [[me|me]]" and not (root / "notes/self.md").exists()


def test_invalid_utf8_fails_the_query(spark, root):
    write(root, {"bad/x.md": b"---\n---\n\xff"})
    with pytest.raises(Exception):
        Vault(spark, str(root)).notes("bad").query().df.collect()


def test_empty_folder(spark, root):
    (root / "empty").mkdir()
    notes = Vault(spark, str(root)).notes("empty")
    assert notes.query(["a = 1"], sort="a", limit=3).df.collect() == [] and notes.count().first()[0] == 0
    assert notes.tags().collect() == [] and notes.fields_profile().collect() == [] and notes.unresolved().collect() == [] and notes.infer_schema().collect() == []
