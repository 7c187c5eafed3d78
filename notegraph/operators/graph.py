"""The link graph: edges, graph fields, link filters, traversal, unresolved links.

Outgoing edges keep the raw target; of notes that share a name the last path's links
count.  Incoming edges go by the part of a target after its last slash, and merge all
notes of a name.  Both are plain edge tables; counts never gather a hub's links.

The links of a set of notes are extracted once, in a pass that parses no frontmatter it
needn't, and written to the shared folder; every graph operator reads that table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import trim_space
from ..plans.fields import GRAPH_FIELDS
from ..plans.predicates import compile_clauses, compile_term, parse_clauses, parse_term
from ..session import materialise
from .records import Records

# Fixed patterns of the link syntax.
WIKI_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?\|?[^\]]*\]\]"
FENCED_CODE = r"(?s)```.*?```"
INLINE_CODE = r"`[^`]+`"


def links_of(content: Column) -> Column:
    """Distinct link targets of a text, code left out, sorted."""
    plain = F.when(content.contains("`"), F.regexp_replace(F.regexp_replace(content, FENCED_CODE, ""), INLINE_CODE, "")).otherwise(content)
    found = F.transform(F.regexp_extract_all(plain, F.lit(WIKI_LINK), 1), trim_space)
    return F.when(content.contains("[["), F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def resolve_target(target: Column) -> Column:
    return F.element_at(F.split(target, "/"), -1)


class Graph:
    """Edge tables of a set of notes (path_key, name, content)."""

    def __init__(self, notes: DataFrame):
        self.notes = notes

    @cached_property
    def linked(self) -> DataFrame:
        """(path_key, name, links) of every note, written at first use."""
        return materialise(self.notes.select("path_key", "name", links_of(F.col("content")).alias("links")), "links")

    @cached_property
    def shared(self) -> DataFrame | None:
        """(name) of the names that several notes share, written at first use; None if there are none."""
        names = materialise(self.ambiguous().select("name"), "shared")
        return None if names.isEmpty() else names

    def last_of(self, table: DataFrame, column: str) -> DataFrame:
        """(name, ``column``) of the last note of each name, from a written table that has path_key too.

        Only names that several notes share are shuffled and grouped.
        """
        if self.shared is None:
            return table.select("name", column)
        several = table.join(self.shared, "name", "left_semi").groupBy("name").agg(F.max_by(column, "path_key").alias(column))
        return table.join(self.shared, "name", "left_anti").select("name", column).unionByName(several)

    @property
    def last(self) -> DataFrame:
        """(name, links) of the last note of each name."""
        return self.last_of(self.linked, "links")

    @property
    def out(self) -> DataFrame:
        """(src, dst): outgoing edges with raw targets."""
        return self.last.select(F.col("name").alias("src"), F.explode("links").alias("dst"))

    @property
    def incoming(self) -> DataFrame:
        """(dst, src): incoming edges by resolved target, each once.  Only those of shared names need to be shuffled for that."""
        paths = F.array_join("links", "").contains("/")
        targets = F.when(paths, F.array_distinct(F.transform("links", resolve_target))).otherwise(F.col("links"))
        edges = lambda table: table.select(F.explode(targets).alias("dst"), F.col("name").alias("src"))
        if self.shared is None:
            return edges(self.linked)
        return edges(self.linked.join(self.shared, "name", "left_anti")).unionByName(edges(self.linked.join(self.shared, "name", "left_semi")).distinct())

    @property
    def names(self) -> DataFrame:
        return self.linked.select("name") if self.shared is None else self.linked.select("name").distinct()

    def ambiguous(self) -> DataFrame:
        """name, n: names that several notes share."""
        return self.linked.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")

    # -- graph fields ------------------------------------------------------------

    def attach(self, df: DataFrame, fields: set[str], names: DataFrame | None = None) -> DataFrame:
        """``df`` with those of the graph fields that are asked for, joined by name; ``names``: all names in it, if few."""
        few = lambda table, name: table if names is None else table.join(names.withColumnRenamed("name", name), name, "left_semi")
        wanted = [f for f in GRAPH_FIELDS if f in fields]
        if {"_links", "_link_count"} & set(wanted):
            columns = [c for c, f in ((F.col("links").alias("_links"), "_links"), (F.size("links").cast("long").alias("_link_count"), "_link_count")) if f in wanted]
            df = df.join(few(self.last, "name").select("name", *columns), "name", "left")
        if {"_backlinks", "_backlink_count"} & set(wanted):
            gather = [c for c, f in ((F.array_sort(F.collect_list("src")).alias("_backlinks"), "_backlinks"), (F.count("*").alias("_backlink_count"), "_backlink_count")) if f in wanted]
            df = df.join(few(self.incoming, "dst").groupBy("dst").agg(*gather).withColumnRenamed("dst", "name"), "name", "left")
        filled = {f: F.coalesce(f, F.lit(0).cast("long") if f.endswith("count") else F.array().cast("array<string>")) for f in wanted}
        return df.withColumns(filled) if filled else df

    # -- link filters ------------------------------------------------------------

    def links_to(self, target: str) -> DataFrame:
        """Names with an outgoing link written as ``target``."""
        return self.last.filter(F.array_contains("links", target)).select("name")

    def linked_from(self, source: str) -> DataFrame:
        """Names that a note named ``source`` links to."""
        return self.incoming.filter(F.col("src") == source).select(F.col("dst").alias("name"))

    def _satisfying(self, records: Callable[[set[str], DataFrame], Records], names: DataFrame, term: str) -> DataFrame:
        """Those of ``names`` whose last record satisfies one term; only their notes are parsed, and the answer is written."""
        parsed = parse_term(term)
        some = records({parsed.field}, materialise(names.distinct(), "candidates"))
        held = F.coalesce(compile_term(parsed, some.resolve(parsed.field)), F.lit(False))
        return self.last_of(materialise(some.df.select("name", "path_key", held.alias("held")), "held"), "held").filter("held").select("name")

    def links_to_where(self, records: Callable[[set[str], DataFrame], Records], term: str) -> DataFrame:
        """Names with an outgoing link to one that satisfies the term; ``records`` gives the records of some names."""
        hits = self._satisfying(records, self.linked.select(F.explode("links").alias("name")), term).withColumnRenamed("name", "dst")
        return self.out.join(hits, "dst", "left_semi").select(F.col("src").alias("name")).distinct()

    def linked_from_where(self, records: Callable[[set[str], DataFrame], Records], term: str) -> DataFrame:
        """Names that one that satisfies the term links to."""
        hits = self._satisfying(records, self.linked.filter(F.size("links") > 0).select("name"), term).withColumnRenamed("name", "src")
        return self.incoming.join(hits, "src", "left_semi").select(F.col("dst").alias("name")).distinct()

    # -- one note's links --------------------------------------------------------

    def links(self, name: str, direction: str = "both") -> DataFrame:
        """direction, other, resolved: the links of one note; backlinks always are resolved."""
        known = self.names.withColumnRenamed("name", "other")
        out = self.out.filter(F.col("src") == name).select(F.lit("outgoing").alias("direction"), F.col("dst").alias("other"))
        out = out.join(known.withColumn("resolved", F.lit(True)), "other", "left").select("direction", "other", F.coalesce("resolved", F.lit(False)).alias("resolved"))
        back = self.incoming.filter(F.col("dst") == name).select(F.lit("incoming").alias("direction"), F.col("src").alias("other"), F.lit(True).alias("resolved"))
        return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]

    # -- traversal ---------------------------------------------------------------

    def traverse(self, start: str, depth: int = 2, direction: str = "outgoing") -> DataFrame:
        """name, depth, route: every name within ``depth`` steps, in breadth-first order by (depth, route).

        One join for each step; the visited names are excluded by an anti-join, and each
        step is a written table.  ``route`` is the chain of choices that found a name
        first (out before in, then by name), which orders a level without a global sort.
        """
        edges = []
        if direction in ("outgoing", "both"):
            edges.append(self.out.select("src", F.concat(F.lit("0"), "dst").alias("choice"), "dst"))
        if direction in ("incoming", "both"):
            edges.append(self.incoming.select(F.col("dst").alias("src"), F.concat(F.lit("1"), "src").alias("choice"), F.col("src").alias("dst")))
        table = edges[0] if len(edges) == 1 else edges[0].union(edges[1])
        if depth > 1:
            table = materialise(table, "traverse-edges")
        session = self.notes.sparkSession
        frontier = session.range(1).select(F.lit(start).alias("name"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("route"))
        reached = frontier
        for step in range(1, depth + 1):
            next_names = frontier.join(table, F.col("name") == F.col("src")).select("dst", F.concat("route", F.array("choice")).alias("route")).groupBy("dst").agg(F.min("route").alias("route"))
            frontier = next_names.join(reached.select(F.col("name").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("name"), F.lit(step).alias("depth"), "route")
            frontier = materialise(frontier, "traverse")
            if frontier.isEmpty():
                break
            reached = reached.unionByName(frontier)
        return reached

    def traverse_records(self, records: Callable[[DataFrame], Records], start: str, depth: int = 2, direction: str = "outgoing", where: tuple[str, ...] = (), select: tuple[str, ...] = ()) -> DataFrame:
        """Traversal joined to the records: name, depth, route, resolved, then ``select`` as display text.

        ``records`` gives the records of some names; only those that the walk reached are read.
        ``where`` filters what is shown, not what is walked; a name without a record fails it.
        Empty if only the start was reached and it is no record.
        """
        walked = self.traverse(start, depth, direction)
        if where or select:
            reached = records(walked.select("name"))
            held = F.coalesce(compile_clauses(parse_clauses(list(where)), reached.resolve), F.lit(False))
            shown = materialise(reached.df.select("name", "path_key", F.struct(held.alias("_held"), *[reached.column(f, as_text=True).alias(f) for f in select]).alias("record")), "shown")
            shown = self.last_of(shown, "record").select("name", F.lit(True).alias("resolved"), "record.*").filter("_held").drop("_held")
        else:
            shown = self.names.join(walked.select("name"), "name", "left_semi").withColumn("resolved", F.lit(True))
        walked = walked.join(shown, "name", "inner" if where else "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
        alone = (F.col("depth") == 0) & ~F.col("resolved")
        if not where:
            others = walked.filter("depth > 0").agg(F.count("*").alias("others")).scalar()
            walked = walked.filter(~alone | (others > 0))
        return walked.select("name", "depth", "route", "resolved", *select).orderBy("depth", "route")

    # -- unresolved --------------------------------------------------------------

    def unresolved(self, start: str | None = None, depth: int = 2, list_sources: bool = False) -> DataFrame:
        """target, n (and sources): link targets that are no note, by how many notes link to them.

        A note counts once for each note of its name.  With ``start``, only notes
        within ``depth`` outgoing steps are looked at.
        """
        sources = self.linked.select(F.col("name").alias("src"))
        if start is not None:
            sources = sources.join(self.traverse(start, depth).select(F.col("name").alias("src")), "src", "left_semi")
        dangling = self.out.join(self.names.withColumnRenamed("name", "dst"), "dst", "left_anti")
        return dangling.join(sources, "src").groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n"), *([F.array_sort(F.collect_list("src")).alias("sources")] if list_sources else [])).orderBy(F.desc("n"), "target")
