"""A vault: a tree of notes as a database.  Folders are tables, notes are records."""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EditError, NoteError
from .functions.editing import apply_edits, quoted
from .functions.frontmatter import split_note
from .operators import mutate, output, schema
from .operators.apply import move_files, remove_files, replace_text, taken, trash_files, write_texts
from .operators.graph import Graph
from .operators.records import Records, fields_in
from .plans.fields import GRAPH_FIELDS, VIRTUAL_FIELDS, NoteFields
from .session import materialise, ship
from .sources.notes import discover, judged, named, read_folder, resolve_folder

SCHEMA_FILE = "schema.yaml"
TRASH = ".trash"


class Notes:
    """A set of notes to query: one folder of a vault, or any table of (path, content)."""

    def __init__(self, base: DataFrame, root_name: str = ""):
        """``base``: texts as ``named`` gives them."""
        self.base, self.df, self.root_name = base, judged(base), root_name
        self.graph = Graph(self.df)

    @classmethod
    def of_texts(cls, texts: DataFrame, root_name: str = "") -> Notes:
        ship(texts.sparkSession)
        return cls(named(texts), root_name)

    def records(self, fields: set[str] | None = None, names: DataFrame | None = None, parse: bool = True) -> Records:
        """All notes as records, or those of the names in ``names``; the graph fields among ``fields`` are attached.

        Other names are left out before any graph field is joined, and before any text is parsed:
        if many names stay, texts are shuffled for that.  Where nothing is going to be parsed
        (``parse`` is false) only paths and names are.
        """
        df = self.base if parse and names is not None else self.df
        df = df if names is None else df.join(names, "name", "left_semi").select(*df.columns)
        df = judged(df) if parse and names is not None else df
        df = self.graph.attach(df, (fields or set()) & set(GRAPH_FIELDS), names)
        return Records(df, NoteFields(df, self.root_name), ("path_key",))

    def query(
        self,
        where: Iterable[str] = (),
        sort: str | None = None,
        desc: bool = False,
        limit: int | None = None,
        links_to: Iterable[str] = (),
        linked_from: Iterable[str] = (),
        links_to_where: Iterable[str] = (),
        linked_from_where: Iterable[str] = (),
        fields: Iterable[str] = (),
    ) -> Records:
        """Matching records, in order.  ``fields``: those that will be selected, if they are graph fields."""
        where, names = list(where), None
        hits = [self.graph.links_to(target) for target in links_to] + [self.graph.linked_from(source) for source in linked_from]
        hits += [self.graph.links_to_where(self.records, term) for term in links_to_where] + [self.graph.linked_from_where(self.records, term) for term in linked_from_where]
        for found in hits:
            names = found if names is None else names.join(found, "name", "left_semi")
        if names is not None:  # written, so that Spark knows how few they are before it plans what they restrict
            names = materialise(names, "linked-names")
        used = fields_in(*where) | ({sort} if sort else set())
        parse = not used <= set(VIRTUAL_FIELDS) - {"_body_length"}
        return self.records(used | set(fields), names, parse).where(*where).sorted(sort, desc, limit)

    def count(self, where: Iterable[str] = ()) -> DataFrame:
        where = list(where)
        return self.records(fields_in(*where)).where(*where).count()

    def fields_profile(self) -> DataFrame:
        return self.records().field_profile()

    def tags(self) -> DataFrame:
        return self.records().tags()

    def unresolved(self, start: str | None = None, depth: int = 2, list_sources: bool = False) -> DataFrame:
        return self.graph.unresolved(start, depth, list_sources)

    def links(self, name: str, direction: str = "both") -> DataFrame:
        return self.graph.links(name, direction)

    def traverse(self, name: str, depth: int = 2, direction: str = "outgoing", where: Iterable[str] = (), select: Iterable[str] = ()) -> DataFrame:
        where, select = tuple(where), tuple(select)
        return self.graph.traverse_records(lambda names: self.records(fields_in(*where) | set(select), names), name, depth, direction, where, select)

    def validate(self, collection: schema.Collection) -> DataFrame:
        mutate_fields = fields_in(*collection.filter) & set(GRAPH_FIELDS)
        if mutate_fields:
            raise NoteError(f"a collection's filter cannot use link fields: {', '.join(sorted(mutate_fields))}")
        return schema.validate(self.records(), collection)

    def infer_schema(self) -> DataFrame:
        return schema.infer(self.records())

    def update_plan(self, where: Iterable[str], **edits: Iterable[str]) -> DataFrame:
        return mutate.update_plan(mutate.guarded(self.records(), where, "update"), mutate.edits_of(**edits))

    def move_plan(self, where: Iterable[str], to: str, everything: DataFrame | None = None) -> DataFrame:
        return mutate.move_plan(mutate.guarded(self.records(), where, "move"), everything if everything is not None else self.df, to)

    def delete_plan(self, where: Iterable[str], whole: Graph | None = None) -> DataFrame:
        return mutate.delete_plan(mutate.guarded(self.records(), where, "delete"), whole or self.graph)

    def rename_plan(self, old: str, new: str) -> DataFrame:
        return mutate.rename_plan(self.graph, old, new)

    def render(self, found: Records, select: str | None = None, form: str = "table", verbose: bool = False) -> str:
        """The text that a console shows; ``verbose`` prints the number of records to the error stream."""
        text = output.render(found, [f.strip() for f in select.split(",")] if select else None, form)
        if verbose:
            print(f"{found.df.count()} record(s) matched", file=sys.stderr)
        return text


class Vault:
    """A vault in a folder that is mounted on all nodes.  Changes are plans unless ``apply`` is true.

    Files are listed, read and changed by the tasks; a plan is written to the shared folder
    before it is applied.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, start: str = "."):
        self.spark, self.root = ship(spark), os.path.abspath(root) if root is not None else discover(start)

    def notes(self, folder: str = "", recursive: bool = False) -> Notes:
        return Notes.of_texts(read_folder(self.spark, self.root, folder, recursive), os.path.basename(self.root))

    def whole(self) -> Notes:
        return self.notes("", True)

    def collections(self) -> dict[str, schema.Collection]:
        return schema.load_file(os.path.join(self.root, SCHEMA_FILE))

    # -- schema ------------------------------------------------------------------

    def schema_show(self, folder: str) -> DataFrame:
        return schema.show(self.spark, schema.for_folder(self.collections(), folder))

    def schema_validate(self, folder: str, recursive: bool = False) -> DataFrame:
        """collection, file, field, message for every collection of the folder."""
        found, checked = schema.for_folder(self.collections(), folder), None
        records = self.notes(folder, recursive) if found else None
        for name, collection in found.items():
            part = records.validate(collection).select(F.lit(name).alias("collection"), "file", "field", "message")
            checked = part if checked is None else checked.unionByName(part)
        return checked if checked is not None else self.spark.createDataFrame([], "collection string, file string, field string, message string")

    def schema_init(self, folder: str, recursive: bool = False) -> str:
        return schema.dump({folder: schema.infer_collection(self.notes(folder, recursive).records(), folder)})

    # -- changes -----------------------------------------------------------------

    def create(self, folder: str, name: str, template: str | None = None, set: Iterable[str] = (), apply: bool = False) -> str:
        """The text of a new note, written if ``apply``."""
        path = os.path.join(resolve_folder(self.root, folder), f"{name}.md")
        if os.path.exists(path):
            raise NoteError(f"file already exists: {path}")
        text = f"---\n---\n\n# {name}\n"
        if template is not None:
            try:
                with open(os.path.join(self.root, template), encoding="utf-8", newline="") as f:
                    text = f.read()
            except OSError as e:
                raise NoteError(f"template not found: {template}") from e
        for edit in mutate.edits_of(set=set) if list(set := list(set)) else []:
            if split_note(text) is not None:
                text, _ = apply_edits(text, [edit])
            else:
                text = f"---\n{edit.key}: {quoted(edit.value)}\n---\n{text}"
        if apply:
            replace_text(path, text)
        return text

    def update(self, folder: str, where: Iterable[str], recursive: bool = False, apply: bool = False, **edits: Iterable[str]) -> DataFrame:
        plan = self.notes(folder, recursive).update_plan(where, **edits)
        if apply:
            plan = materialise(plan, "update")
            failed = plan.filter("error is not null").orderBy("path_key").select("path", "error").first()
            if failed:
                raise EditError(f"{failed['path']}: {failed['error']}; nothing was written")
            write_texts(plan, self.root)
        return plan

    def rename(self, old: str, new: str, folder: str = "", apply: bool = False) -> DataFrame:
        base = resolve_folder(self.root, folder)
        source, target = (os.path.join(base, f"{n}.md") for n in (old, new))
        if not os.path.exists(source):
            raise NoteError(f"file not found: {source}")
        if os.path.exists(target):
            raise NoteError(f"target already exists: {target}")
        whole = self.whole()
        if not whole.graph.ambiguous().filter(F.col("name") == new).isEmpty():
            raise NoteError(f"several notes are named '{new}'")
        plan = whole.rename_plan(old, new)
        if apply:
            plan = materialise(plan, "rename")
            write_texts(plan, self.root)  # texts first, the file last: a note that links to itself moves along
            os.rename(source, target)
        return plan

    def move(self, folder: str, where: Iterable[str], to: str, recursive: bool = False, apply: bool = False) -> DataFrame:
        there = os.path.join(self.root, to)
        everything = self.notes(to).df if os.path.isdir(there) else self.spark.createDataFrame([], "path string")
        plan = self.notes(folder, recursive).move_plan(where, to, everything)
        if apply:
            plan = materialise(plan, "move")
            if conflict := plan.filter("conflict").first() or plan.join(taken(plan, self.root), "path", "left_semi").first():
                raise NoteError(f"conflict: {conflict['new_path']}")
            os.makedirs(there, exist_ok=True)
            move_files(plan, self.root)
        return plan

    def delete(self, folder: str, where: Iterable[str], recursive: bool = False, force: bool = False, apply: bool = False) -> DataFrame:
        plan = self.notes(folder, recursive).delete_plan(where, self.whole().graph)
        if apply:
            plan = materialise(plan, "delete")
            if force:
                remove_files(plan, self.root)
            else:
                os.makedirs(os.path.join(self.root, TRASH), exist_ok=True)
                trash_files(plan, self.root, TRASH, int(time.time()))
        return plan
