"""Registered queries of the record engine, each with SQL that gives the same rows.

Most run the whole text pipeline over notes rendered from the tables (render, split,
YAML, cells, links, query); the SQL computes the answer from the tables themselves.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import NoteError
from .operators import output, schema
from .operators.records import Records, from_table
from .session import materialise, own_folder
from .sources import render
from .vault import Notes, Vault

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _notes(spark: SparkSession, *texts: DataFrame) -> Notes:
    whole = texts[0]
    for t in texts[1:]:
        whole = whole.unionByName(t)
    return Notes.of_texts(whole, "vault")


def _pick(records: Records, *fields: str) -> DataFrame:
    """``_name`` as name and the fields as display text (``#field``: as a number)."""
    number = lambda f: records.resolve(f).number.alias(f.lstrip("_"))
    return records.df.select(*[number(f[1:]) if f[0] == "#" else records.column(f).alias(f.lstrip("_")) for f in ("_name", *fields)])


def _pick_vip(records: Records) -> DataFrame:
    """``vip`` with its kind, which tells a null from an absent field."""
    return records.df.select("name", records.column("vip").alias("vip"), records.resolve("vip").kind.alias("vip_kind"))


def _register(name: str, sql: str):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], SQL[name] = query, sql
        return query

    return add


# --- predicates ---------------------------------------------------------------------

_O = "printf('O%09d', o_orderkey)"
_C = "printf('C%09d', c_custkey)"
_P = "printf('P%09d', p_partkey)"
_VIP = "CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'gold' ELSE 'silver' END END"
_MONEY = lambda c: f"CAST(CAST({c} AS DECIMAL(18,2)) AS DOUBLE)"
_ORDER_SQL = f"SELECT {_O} AS name, o_orderstatus AS status, {_MONEY('o_totalprice')} AS totalprice FROM orders WHERE "
_PART_SQL = f"SELECT {_P} AS name, p_type AS type, CAST(p_size AS DOUBLE) AS size FROM part WHERE "
_VIP_KIND = "CASE c_custkey % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'null' END"
_VIP_SHOWN = f"CASE c_custkey % 3 WHEN 0 THEN {_VIP} WHEN 1 THEN '' END"  # null has an empty text, an absent field none
_CUSTOMER_SQL = f"SELECT {_C} AS name, {_VIP_SHOWN} AS vip, {_VIP_KIND} AS vip_kind FROM customer WHERE "

_WHERE = {
    # orders: text and numbers
    "where_eq": ("orders", ["status = F"], "o_orderstatus = 'F'"),
    "where_neq": ("orders", ["status != F"], "o_orderstatus <> 'F'"),
    "where_gt": ("orders", ["totalprice > 200000"], "CAST(o_totalprice AS DECIMAL(18,2)) > 200000"),
    "where_lt": ("orders", ["totalprice < 50000.5"], "CAST(o_totalprice AS DECIMAL(18,2)) < 50000.5"),
    "where_gt_text": ("orders", ["orderdate > 1998-06-30"], "CAST(o_orderdate AS DATE) > DATE '1998-06-30'"),
    "where_and": ("orders", ["status = O", "totalprice > 300000"], "o_orderstatus = 'O' AND CAST(o_totalprice AS DECIMAL(18,2)) > 300000"),
    "where_or": ("orders", ["status = P || totalprice > 400000"], "o_orderstatus = 'P' OR CAST(o_totalprice AS DECIMAL(18,2)) > 400000"),
    "where_and_of_or": ("orders", ["status = P || status = F", "year = 1997 || priority startswith 1"], "o_orderstatus IN ('P', 'F') AND (year(o_orderdate) = 1997 OR o_orderpriority LIKE '1%')"),
    # parts
    "where_gte": ("parts", ["size >= 45"], "p_size >= 45"),
    "where_lte": ("parts", ["size <= 3"], "p_size <= 3"),
    "where_contains_substr": ("parts", ["type contains AND"], "p_type LIKE '%AND%'"),
    "where_startswith": ("parts", ["type startswith S"], "p_type LIKE 'S%'"),
    "where_endswith": ("parts", ["type endswith UM"], "p_type LIKE '%UM'"),
    "where_matches": ("parts", ["type matches ^(SMALL|LARGE)$"], "p_type IN ('SMALL', 'LARGE')"),
    "where_text_of_number": ("parts", ["size startswith 4"], "CAST(p_size AS VARCHAR) LIKE '4%'"),
    # customers: a list, an optional field
    "where_contains_list": ("customers", ["tags contains segment/BUILDING"], "c_mktsegment = 'BUILDING'"),
    "where_not_contains_list": ("customers", ["tags !contains segment/BUILDING"], "c_mktsegment <> 'BUILDING'"),
    "where_not_contains": ("customers", ["vip !contains old"], f"coalesce({_VIP}, '') <> 'gold'"),
    "where_not_startswith": ("customers", ["vip !startswith g"], f"coalesce({_VIP}, '') <> 'gold'"),
    "where_not_endswith": ("customers", ["vip !endswith er"], f"coalesce({_VIP}, '') <> 'silver'"),
    "where_not_matches": ("customers", ["vip !matches ^s.l"], f"coalesce({_VIP}, '') <> 'silver'"),
    "where_exists": ("customers", ["vip exists"], f"{_VIP} IS NOT NULL"),
    "where_missing": ("customers", ["vip missing"], f"{_VIP} IS NULL"),
    "where_not_exists": ("customers", ["vip !exists"], f"{_VIP} IS NULL"),
    "where_not_missing": ("customers", ["vip !missing"], f"{_VIP} IS NOT NULL"),
    "where_numeric_string": ("customers", ["code = 7"], "c_custkey % 10 = 7"),
    "where_neq_null": ("customers", ["vip != gold"], f"{_VIP} <> 'gold'"),
    "where_virtual_name": ("customers", ["_name > C000001000", "_folder = customers"], "c_custkey > 1000"),
}
_SHOWN = {"orders": ("status", "#totalprice"), "parts": ("type", "#size")}


def _add_where(name: str, kind: str, clauses: list[str], condition: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = _notes(spark, getattr(render, kind)(spark, sf_dir)).records().where(*clauses)
        return _pick_vip(records) if kind == "customers" else _pick(records, *_SHOWN[kind])

    QUERIES[name], SQL[name] = query, {"orders": _ORDER_SQL, "parts": _PART_SQL, "customers": _CUSTOMER_SQL}[kind] + condition


for _name, _spec in _WHERE.items():
    _add_where(_name, *_spec)


# --- projection, virtual fields, order ------------------------------------------------

_HEAD = "'---' || chr(10) || 'tags:' || chr(10) || '  - lang/' || lang || chr(10) || 'source: ' || source || chr(10) || 'n_chars: ' || n_chars || chr(10) || CASE WHEN quality IS NOT NULL THEN 'quality: ' || quality || chr(10) || 'toxic: ' || toxic || chr(10) ELSE '' END || '---' || chr(10)"
_D = "printf('D%09d', d.doc_id)"


@_register("select_virtual", f"SELECT {_D} AS name, 'documents/' || {_D} || '.md' AS path, 'documents' AS folder, source, quality::VARCHAR AS quality FROM documents d LEFT JOIN labels USING (doc_id)")
def select_virtual(spark, sf_dir):
    return _pick(_notes(spark, render.documents(spark, sf_dir)).records(), "_path", "_folder", "source", "quality")


@_register("file_lengths", f"SELECT {_D} AS name, CAST(strlen({_HEAD}) + strlen(text) AS BIGINT) AS length, CAST(strlen(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS body_length FROM documents d LEFT JOIN labels USING (doc_id)")
def file_lengths(spark, sf_dir):
    return _pick(_notes(spark, render.documents(spark, sf_dir)).records(), "_length", "_body_length")


@_register("percent_names", "SELECT 'C ' || c_custkey || 'é%2x' AS name, 'people' AS folder FROM customer WHERE c_custkey % 10 <> 3")
def percent_names(spark, sf_dir):
    """Names are decoded, a malformed escape stays; bytes are Latin-1."""
    key = F.col("c_custkey").cast("string")
    texts = render.table(spark, sf_dir, "customer").select(F.concat(F.lit("people/C%20"), key, F.lit("%E9%2x.md")).alias("path"), F.lit("no frontmatter").alias("content"))
    return _pick(_notes(spark, texts).records().where("_name !matches 3é%2x$"), "_folder")


@_register("times", f"SELECT {_O} AS name, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || printf(' %02d:%02d', 4 + o_orderkey % 20, o_orderkey % 60) AS modified, NULL::VARCHAR AS created FROM orders WHERE year(o_orderdate) >= 1997")
def times(spark, sf_dir):
    """Times as text, to the minute; a time that is not known is an absent field."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    mtime = F.make_timestamp(F.year(day), F.month(day), F.day(day), 4 + key % 20, key % 60, F.lit(59.5)).alias("mtime")
    texts = render.table(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), render.note_name("O", key), F.lit(".md")).alias("path"), F.lit("").alias("content"), mtime)
    return _pick(_notes(spark, texts).records().where("_modified >= 1997-01-01", "_created missing"), "_modified", "_created")


@_register("sort_limit", f"SELECT {_O} AS name, {_MONEY('o_totalprice')} AS totalprice FROM orders ORDER BY totalprice DESC, name DESC LIMIT 25")
def sort_limit(spark, sf_dir):
    return _pick(_notes(spark, render.orders(spark, sf_dir)).query(sort="totalprice", desc=True, limit=25), "#totalprice")


_SORT_SQL = "SELECT name, vip, vip_kind FROM (SELECT " + f"{_C} AS name, {_VIP_SHOWN} AS vip, {_VIP_KIND} AS vip_kind".replace("%", "%%") + ", CASE c_custkey %% 3 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM customer) ORDER BY rank %s, vip %s, name %s LIMIT 700"


@_register("sort_missing_first", _SORT_SQL % (("ASC",) * 3))
def sort_missing_first(spark, sf_dir):
    return _pick_vip(_notes(spark, render.customers(spark, sf_dir)).query(sort="vip", limit=700))


@_register("sort_desc_ties", _SORT_SQL % (("DESC",) * 3))
def sort_desc_ties(spark, sf_dir):
    return _pick_vip(_notes(spark, render.customers(spark, sf_dir)).query(sort="vip", desc=True, limit=700))


@_register("nested_values", "SELECT printf('V%09d', conv_id) AS name, '[' || string_agg('{\"role\":\"' || role || '\",\"turn\":' || turn || '}', ',' ORDER BY turn) || ']' AS turns FROM conversations GROUP BY conv_id")
def nested_values(spark, sf_dir):
    records = _notes(spark, render.conversations(spark, sf_dir)).records()
    return records.df.select(F.col("name"), records.resolve("turns").json.alias("turns"))


# --- aggregates -----------------------------------------------------------------------


@_register("count_where", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) >= 1998")
def count_where(spark, sf_dir):
    return _notes(spark, render.orders(spark, sf_dir)).count(["status = O", "year >= 1998"])


@_register("count_graph", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) > 10)")
def count_graph(spark, sf_dir):
    return _notes(spark, render.customers(spark, sf_dir), render.orders(spark, sf_dir)).count(["_backlink_count > 10"])


@_register(
    "fields_profile",
    """SELECT 'acctbal' AS field, string_agg(DISTINCT t, ', ' ORDER BY t) AS types, count(*) AS non_null, count(*) AS present, 100 AS coverage FROM (SELECT 'float' AS t FROM customer)
    UNION ALL SELECT 'code', 'string', count(*), count(*), 100 FROM customer
    UNION ALL SELECT 'nation', 'string', count(*), count(*), 100 FROM customer
    UNION ALL SELECT 'tags', 'list', count(*), count(*), 100 FROM customer
    UNION ALL SELECT 'vip', 'null, string', count(*) FILTER (WHERE c_custkey % 3 = 0), count(*) FILTER (WHERE c_custkey % 3 < 2), CAST(round_even(100.0 * count(*) FILTER (WHERE c_custkey % 3 < 2) / count(*), 0) AS INTEGER) FROM customer""",
)
def fields_profile(spark, sf_dir):
    return _notes(spark, render.customers(spark, sf_dir)).fields_profile()


@_register("tags_count", "SELECT tag, count(*) AS n FROM (SELECT 'type/customer' AS tag FROM customer UNION ALL SELECT 'segment/' || c_mktsegment FROM customer UNION ALL SELECT 'type/order' FROM orders UNION ALL SELECT 'status/' || o_orderstatus FROM orders) GROUP BY tag")
def tags_count(spark, sf_dir):
    return _notes(spark, render.customers(spark, sf_dir), render.orders(spark, sf_dir)).tags()


# --- graph ----------------------------------------------------------------------------


def _places(spark, sf_dir):
    return render.regions(spark, sf_dir), render.nations(spark, sf_dir), render.customers(spark, sf_dir)


def _world(spark, sf_dir) -> Notes:
    return _notes(spark, *_places(spark, sf_dir), render.orders(spark, sf_dir))


@_register(
    "backlink_hubs",
    """SELECT name, folder, backlink_count FROM (
      SELECT n_name AS name, 'nations' AS folder, count(c_custkey) AS backlink_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name
      UNION ALL SELECT r_name, 'regions', count(n_nationkey) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
      UNION ALL SELECT printf('C%09d', c_custkey), 'customers', count(o_orderkey) FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
    ORDER BY backlink_count DESC, folder DESC, name DESC LIMIT 20""",
)
def backlink_hubs(spark, sf_dir):
    return _pick(_world(spark, sf_dir).query(sort="_backlink_count", desc=True, limit=20, fields=["_backlink_count"]), "_folder", "_backlink_count")


@_register("orphans", f"SELECT {_O} AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphans(spark, sf_dir):
    return _pick(_notes(spark, render.written(render.orders_parts(spark, sf_dir)), render.parts(spark, sf_dir)).query(["_link_count = 0", "_backlink_count = 0", "_folder = orders"]))


_LINK_LIST = "(SELECT l_orderkey, list_sort(list(DISTINCT printf('P%09d', l_partkey))) AS links FROM lineitem GROUP BY l_orderkey)"


@_register("graph_lists", f"SELECT {_O} AS name, array_to_string(coalesce(links, []), ', ') AS links, CAST(len(coalesce(links, [])) AS BIGINT) AS link_count FROM orders LEFT JOIN {_LINK_LIST} ON l_orderkey = o_orderkey")
def graph_lists(spark, sf_dir):
    notes = _notes(spark, render.written(render.orders_parts(spark, sf_dir)))
    records = notes.records({"_links", "_link_count"})
    return records.df.select("name", records.column("_links", as_text=True).alias("links"), records.column("_link_count").alias("link_count"))


@_register("links_to", f"SELECT {_C} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def links_to(spark, sf_dir):
    return _pick(_world(spark, sf_dir).query(links_to=["NATION_3"]))


@_register("links_to_both", f"SELECT {_O} AS name FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 5) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey <> 5 AND l_partkey BETWEEN 0 AND 1000000) AND o_orderstatus = 'F'")
def links_to_both(spark, sf_dir):
    notes = _notes(spark, render.written(render.orders_parts(spark, sf_dir)))
    return _pick(notes.query(["status = F", "_link_count > 1"], links_to=["P000000005"]))


@_register("linked_from", f"SELECT DISTINCT {_P} AS name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_orderkey BETWEEN 10 AND 10")
def linked_from(spark, sf_dir):
    return _pick(_notes(spark, render.orders_parts(spark, sf_dir), render.parts(spark, sf_dir)).query(linked_from=["O000000010"]))


@_register("links_to_where", f"SELECT {_O} AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(c_acctbal AS DECIMAL(18,2)) > 9000")
def links_to_where(spark, sf_dir):
    return _pick(_world(spark, sf_dir).query(links_to_where=["acctbal > 9000"]))


@_register("linked_from_where", f"SELECT {_C} AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 450000)")
def linked_from_where(spark, sf_dir):
    return _pick(_world(spark, sf_dir).query(linked_from_where=["totalprice > 450000"]))


@_register("links_of_note", "SELECT 'outgoing' AS direction, r_name AS other, true AS resolved FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_7' UNION ALL SELECT 'incoming', printf('C%09d', c_custkey), true FROM customer WHERE c_nationkey = 7")
def links_of_note(spark, sf_dir):
    return _world(spark, sf_dir).links("NATION_7")


@_register("links_outgoing", "SELECT DISTINCT 'outgoing' AS direction, printf('P%09d', l_partkey) AS other, p_size > 25 AS resolved FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = 12")
def links_outgoing(spark, sf_dir):
    return _notes(spark, render.orders_parts(spark, sf_dir), render.parts(spark, sf_dir, where="p_size > 25")).links("O000000012", "outgoing")


@_register("links_outside_code", f"SELECT {_P} AS src, unnest(['A' || p_partkey, 'D ' || p_size, 'dir/E']) AS dst FROM part")
def links_outside_code(spark, sf_dir):
    """Fenced and inline code is left out, across lines too; a lone backtick isn't code."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    body = F.concat(F.lit("See [[A"), key, F.lit("]] `[[B]]` and `x\n[[B2]]`.\n```py\n[[C]] ` [[C2]]\n```\n[[D "), size, F.lit("#part|shown]] ```[[F]]``` [[dir/E]] ` [[A"), key, F.lit("]]\n"))
    return _notes(spark, render.table(spark, sf_dir, "part").select(*render.note("parts", render.note_name("P", F.col("p_partkey")), [], body))).graph.out


_EDGES = """edges AS (
  SELECT printf('C%09d', c_custkey) AS src, n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT printf('O%09d', o_orderkey), printf('C%09d', o_custkey) FROM orders)"""


def _walk_sql(edges: str, start: str, depth: int, where: str = "") -> str:
    return f"WITH RECURSIVE {_EDGES}, e AS ({edges}), w AS (SELECT '{start}' AS name, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.name WHERE w.depth < {depth}) SELECT name, min(depth) AS depth FROM w {where} GROUP BY name"


@_register("traverse_out", _walk_sql("SELECT * FROM edges", "O000000007", 3))
def traverse_out(spark, sf_dir):
    return _world(spark, sf_dir).traverse("O000000007", 3).select("name", "depth")


@_register("traverse_in", _walk_sql("SELECT dst AS src, src AS dst FROM edges", "ASIA", 2))
def traverse_in(spark, sf_dir):
    return _world(spark, sf_dir).traverse("ASIA", 2, "incoming").select("name", "depth")


@_register("traverse_both", _walk_sql("SELECT * FROM edges UNION SELECT dst, src FROM edges", "C000000004", 2))
def traverse_both(spark, sf_dir):
    return _world(spark, sf_dir).traverse("C000000004", 2, "both").select("name", "depth")


@_register("traverse_where", _walk_sql("SELECT dst AS src, src AS dst FROM edges", "ASIA", 2, f"JOIN customer ON name = {_C} WHERE c_mktsegment = 'MACHINERY'").replace("SELECT name, min(depth) AS depth", "SELECT name, min(depth) AS depth, any_value(format('{:.2f}', CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE) AS acctbal"))
def traverse_where(spark, sf_dir):
    walked = _world(spark, sf_dir).traverse("ASIA", 2, "incoming", where=["tags contains segment/MACHINERY"], select=["acctbal"])
    return walked.select("name", "depth", F.col("acctbal").cast("double").alias("acctbal"))


@_register("traverse_ghost", "SELECT 'Gone' AS name, 0 AS depth, false AS resolved UNION ALL SELECT printf('P%09d', p_partkey), 1, true FROM part WHERE p_size > 40")
def traverse_ghost(spark, sf_dir):
    """A name that is no note, but is linked to, is walked from; one that nothing knows gives no rows."""
    parts = render.table(spark, sf_dir, "part").select(*render.note("parts", render.note_name("P", F.col("p_partkey")), [], F.when(F.col("p_size") > 40, "[[x/Gone]]").otherwise("[[P000000001]]")))
    notes = _notes(spark, parts)
    walk = lambda start: notes.traverse(start, 3, "incoming").select("name", "depth", "resolved")
    return walk("Gone").union(walk("Nowhere"))


@_register("unresolved_all", "SELECT printf('P%09d', l_partkey) AS target, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 5 GROUP BY l_partkey")
def unresolved_all(spark, sf_dir):
    return _notes(spark, render.orders_parts(spark, sf_dir), render.parts(spark, sf_dir, where="p_size > 5")).unresolved()


@_register("unresolved_from", "SELECT DISTINCT printf('P%09d', l_partkey) AS target, CAST(1 AS BIGINT) AS n FROM lineitem WHERE l_orderkey = 20")
def unresolved_from(spark, sf_dir):
    return _notes(spark, render.orders_parts(spark, sf_dir)).unresolved("O000000020", 1)


@_register("ambiguous_names", f"SELECT {_P} AS name, CAST(2 AS BIGINT) AS n FROM part WHERE p_size > 40")
def ambiguous_names(spark, sf_dir):
    return _notes(spark, render.parts(spark, sf_dir), render.parts(spark, sf_dir, "archive", "p_size > 40")).graph.ambiguous()


# --- schema ---------------------------------------------------------------------------

PART_RULES = """
collections:
  parts:
    folder: parts
    filter: ["size > 10"]
    required: [size, colour]
    fields:
      type: {type: string, enum: [SMALL, MEDIUM, LARGE, PROMO, STANDARD]}
      size: {type: number, min: 12, max: 45}
      retailprice: {type: integer}
"""


@_register(
    "schema_validate",
    """WITH p AS (SELECT printf('P%09d', p_partkey) AS file, * FROM part WHERE p_size > 10)
    SELECT file, 'colour' AS field, 'required field is missing or null' AS message FROM p
    UNION ALL SELECT file, 'retailprice', 'expected type ''integer'', got ''float''' FROM p
    UNION ALL SELECT file, 'size', 'value ' || p_size || ' is below minimum 12' FROM p WHERE p_size < 12
    UNION ALL SELECT file, 'size', 'value ' || p_size || ' exceeds maximum 45' FROM p WHERE p_size > 45
    UNION ALL SELECT file, 'type', 'value ''' || p_type || ''' not in allowed values: ["SMALL", "MEDIUM", "LARGE", "PROMO", "STANDARD"]' FROM p WHERE p_type NOT IN ('SMALL', 'MEDIUM', 'LARGE', 'PROMO', 'STANDARD')""",
)
def schema_validate(spark, sf_dir):
    return _notes(spark, render.parts(spark, sf_dir)).validate(schema.load(PART_RULES)["parts"])


@_register(
    "schema_infer",
    """SELECT 'orderdate' AS field, 'string' AS type, true AS required, NULL::VARCHAR AS enum
    UNION ALL SELECT 'priority', 'string', true, (SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders)
    UNION ALL SELECT 'status', 'string', true, (SELECT string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) FROM orders)
    UNION ALL SELECT 'tags', 'list', true, NULL
    UNION ALL SELECT 'totalprice', 'float', true, NULL
    UNION ALL SELECT 'year', 'integer', true, (SELECT CASE WHEN count(DISTINCT year(o_orderdate)) <= 10 THEN string_agg(DISTINCT year(o_orderdate)::VARCHAR, '|' ORDER BY year(o_orderdate)::VARCHAR) END FROM orders)""",
)
def schema_infer(spark, sf_dir):
    return _notes(spark, render.orders(spark, sf_dir)).infer_schema().select("field", "type", "required", F.array_join("enum", "|").alias("enum"))


@_register("schema_infer_optional", "SELECT 'vip' AS field, 'string' AS type, false AS required, 'gold|silver' AS enum UNION ALL SELECT 'code', 'string', true, '000|001|002|003|004|005|006|007|008|009' UNION ALL SELECT 'acctbal', 'float', true, NULL UNION ALL SELECT 'tags', 'list', true, NULL UNION ALL SELECT 'nation', 'string', true, NULL")
def schema_infer_optional(spark, sf_dir):
    return _notes(spark, render.customers(spark, sf_dir)).infer_schema().select("field", "type", "required", F.array_join("enum", "|").alias("enum"))


@_register("schema_shown", "SELECT 'parts' AS collection, 'parts' AS folder, 'size > 10' AS filter, 'size, colour' AS required, field, type, enum, lo AS min, hi AS max FROM (VALUES ('retailprice', 'integer', '', NULL::DOUBLE, NULL::DOUBLE), ('size', 'number', '', 12.0, 45.0), ('type', 'string', 'SMALL, MEDIUM, LARGE, PROMO, STANDARD', NULL, NULL)) t(field, type, enum, lo, hi)")
def schema_shown(spark, sf_dir):
    shown = schema.show(spark, schema.for_folder(schema.load(PART_RULES), "parts"))
    return shown.select("collection", "folder", *[F.array_join(c, ", ").alias(c) for c in ("filter", "required")], "field", "type", F.array_join("enum", ", ").alias("enum"), "min", "max")


@_register("columns_shown", "SELECT unnest(['acctbal', 'code', 'key', 'nation', 'tags', 'vip']) AS field")
def columns_shown(spark, sf_dir):
    """The keys that any note has are the columns if none are selected."""
    return _notes(spark, *_places(spark, sf_dir)).records().field_names()


# --- files ----------------------------------------------------------------------------


def _vault(spark: SparkSession, sf_dir: str) -> Vault:
    """A vault of files in the shared folder: regions and nations, one note at the top, and what isn't a note."""
    root = f"{own_folder(spark).removeprefix('file:')}/vault-{uuid.uuid4().hex}"
    if "://" in root:
        raise NoteError("a vault of files needs a shared folder that is mounted")
    for folder in (".obsidian", "regions/nations", "regions/.hidden"):
        os.makedirs(f"{root}/{folder}")
    vault = Vault(spark, root)
    with open(f"{root}/nation.txt", "w", encoding="utf-8") as f:
        f.write("---\ntags:\n  - place\n---\n")
    for r in render.table(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # five rows
        vault.create("regions", r["r_name"], set=[f"key = {r['r_regionkey']}"], apply=True)
    for r in render.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows
        vault.create("regions/nations", r["n_name"], template="nation.txt", set=[f"key = {r['n_nationkey']}", f"region = region {r['n_regionkey']}"], apply=True)
    vault.create("", "Top", apply=True)
    for path, text in (("regions/readme.txt", "no note"), ("regions/.hidden/x.md", ""), ("regions/broken.md", "---\na: [1\n---\n")):
        with open(f"{root}/{path}", "w", encoding="utf-8") as f:
            f.write(text)
    return vault


_REGION_FILE = "'regions/' || r_name || '.md' AS path, r_name AS name, 'regions' AS folder, r_regionkey::VARCHAR AS key, CAST(18 + length(r_name) + length(r_regionkey::VARCHAR) AS BIGINT) AS length"
_NATION_FILE = "'regions/nations/' || n_name || '.md' AS path, n_name AS name, 'nations' AS folder, n_nationkey::VARCHAR AS key, CAST(47 + length(n_nationkey::VARCHAR) AS BIGINT) AS length"


@_register(
    "files_listed",
    f"SELECT 'flat' AS listing, {_REGION_FILE} FROM region UNION ALL SELECT 'deep', {_REGION_FILE} FROM region UNION ALL SELECT 'deep', {_NATION_FILE} FROM nation UNION ALL SELECT 'deep', 'Top.md', 'Top', split_part(path, '/', -1), NULL, 15 FROM (SELECT 'vault' AS path)",
)
def files_listed(spark, sf_dir):
    """Created files, listed flat and with all folders below; dot folders, other files and broken notes are left out."""
    vault = _vault(spark, sf_dir)
    flat, deep = (_pick(vault.notes(folder, recursive).query(), "_path", "_folder", "key", "_length") for folder, recursive in (("regions", False), ("", True)))
    named = lambda df, listing: df.select(F.lit(listing).alias("listing"), "path", "name", F.when(F.col("path") == "Top.md", "vault").otherwise(F.col("folder")).alias("folder"), "key", "length")
    return materialise(named(flat, "flat"), "flat").union(named(deep, "deep"))


@_register(
    "files_changed",
    """SELECT CASE WHEN n_nationkey = 5 THEN 'moved/' || n_name ELSE 'regions/nations/' || CASE n_nationkey WHEN 3 THEN 'Renamed' ELSE n_name END END || '.md' AS path,
      CASE WHEN n_regionkey = 1 THEN 'first' ELSE 'region ' || n_regionkey END AS region, CASE WHEN n_regionkey = 1 THEN 'place, seen' ELSE 'place' END AS tags
    FROM nation WHERE n_nationkey <> 7""",
)
def files_changed(spark, sf_dir):
    """Update, rename, move and delete, applied to files, then what the files hold."""
    vault, nations = _vault(spark, sf_dir), "regions/nations"
    vault.update(nations, ["region = region 1"], set=["region = first"], add_tag=["seen"], apply=True)
    vault.rename("NATION_3", "Renamed", nations, apply=True)
    vault.move(nations, ["key = 5"], "moved", apply=True)
    vault.delete(nations, ["key = 7"], apply=True)
    return _pick(vault.notes("", True).query(["region exists"]), "_path", "region", "tags").drop("name")


# --- change plans ---------------------------------------------------------------------


def _plan(plan: DataFrame) -> DataFrame:
    return plan.select("name", F.array_join("changes", "; ").alias("changes"), F.coalesce(F.octet_length("new_content").cast("long"), F.lit(-1).cast("long")).alias("new_length"), "error")


_OLD_VIP = f"coalesce({_VIP}, '')"
_CUSTOMER_BYTES = f"strlen('---' || chr(10) || 'tags:' || chr(10) || '  - type/customer' || chr(10) || '  - segment/' || c_mktsegment || chr(10) || 'acctbal: ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'vip: ' || {_OLD_VIP} || chr(10) WHEN 1 THEN 'vip:' || chr(10) ELSE '' END || 'code: \"' || printf('%03d', c_custkey % 10) || '\"' || chr(10) || 'nation: \"[[' || n_name || ']]\"' || chr(10) || '---' || chr(10) || chr(10) || '# Customer' || chr(10))"
_FROM_CUSTOMER = "FROM customer JOIN nation ON c_nationkey = n_nationkey"


@_register("update_plan", f"SELECT {_C} AS name, 'set vip = none: yet (was: ' || {_OLD_VIP} || ')' AS changes, CAST({_CUSTOMER_BYTES} + CASE c_custkey % 3 WHEN 0 THEN 11 - strlen({_OLD_VIP}) WHEN 1 THEN 12 ELSE 17 END AS BIGINT) AS new_length, NULL::VARCHAR AS error {_FROM_CUSTOMER} WHERE c_mktsegment = 'BUILDING'")
def update_plan(spark, sf_dir):
    return _plan(_notes(spark, render.customers(spark, sf_dir)).update_plan(["tags contains segment/BUILDING"], set=["vip = none: yet"]))


@_register("tag_plans", f"SELECT {_C} AS name, 'add tag: seen; remove tag: type/customer' AS changes, CAST({_CUSTOMER_BYTES} + 9 - 18 AS BIGINT) AS new_length, NULL::VARCHAR AS error {_FROM_CUSTOMER} WHERE CAST(c_acctbal AS DECIMAL(18,2)) < 100")
def tag_plans(spark, sf_dir):
    return _plan(_notes(spark, render.customers(spark, sf_dir)).update_plan(["acctbal < 100"], add_tag=["seen"], remove_tag=["type/customer"]))


@_register("unset_plan", f"SELECT {_C} AS name, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'unset vip (was: ' || {_OLD_VIP} || ')' END AS changes, CASE c_custkey % 3 WHEN 0 THEN CAST({_CUSTOMER_BYTES} - 6 - strlen({_OLD_VIP}) AS BIGINT) WHEN 1 THEN CAST({_CUSTOMER_BYTES} - 5 AS BIGINT) ELSE -1 END AS new_length, CASE WHEN c_custkey % 3 = 2 THEN 'field ''vip'' not found' END AS error {_FROM_CUSTOMER} WHERE c_custkey % 10 = 3")
def unset_plan(spark, sf_dir):
    return _plan(_notes(spark, render.customers(spark, sf_dir)).update_plan(["code = 3"], unset=["vip"]))


@_register("rename_plan", f"SELECT {_C} AS name, 1 AS links, CAST({_CUSTOMER_BYTES} - strlen(n_name) + 7 AS BIGINT) AS new_length {_FROM_CUSTOMER} WHERE n_name = 'NATION_5'")
def rename_plan(spark, sf_dir):
    plan = _notes(spark, *_places(spark, sf_dir)).rename_plan("NATION_5", "Nowhere")
    return plan.select("name", "links", F.octet_length("new_content").cast("long").alias("new_length"))


@_register("move_plan", f"SELECT 'parts/' || {_P} || '.md' AS path, 'archive/' || {_P} || '.md' AS new_path, p_size > 45 AS conflict FROM part WHERE p_size > 40")
def move_plan(spark, sf_dir):
    parts, archive = render.parts(spark, sf_dir), render.parts(spark, sf_dir, "archive", "p_size > 45")
    return _notes(spark, parts).move_plan(["size > 40"], "archive", archive).drop("path_key")


@_register("delete_plan", f"SELECT {_P} AS name, count(DISTINCT l_orderkey) AS dangling FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_type = 'PROMO' GROUP BY p_partkey")
def delete_plan(spark, sf_dir):
    whole = _notes(spark, render.orders_parts(spark, sf_dir), render.parts(spark, sf_dir))
    return _notes(spark, render.parts(spark, sf_dir)).delete_plan(["type = PROMO"], whole.graph).select("name", "dangling")


# --- output ---------------------------------------------------------------------------


@_register("output_json", f"SELECT '{{\"_name\":\"' || {_P} || '\",\"colour\":null,\"size\":' || p_size || ',\"tags\":[\"type/part\",\"brand/' || p_brand || '\"]}}' AS value FROM part")
def output_json(spark, sf_dir):
    return output.lines(_notes(spark, render.parts(spark, sf_dir)).records(), ["tags", "size", "_name", "colour"], "json")


@_register("output_csv", f"SELECT {_P} || ',\"type/part, brand/' || p_brand || '\",' || p_size || ',' AS value FROM part")
def output_csv(spark, sf_dir):
    return output.lines(_notes(spark, render.parts(spark, sf_dir)).records(), ["_name", "tags", "size", "colour"], "csv")


@_register("output_yaml", f"SELECT '---' || chr(10) || '_name: ' || {_P} || chr(10) || 'tags: type/part, brand/' || p_brand || chr(10) || 'colour: ' || chr(10) AS value FROM part")
def output_yaml(spark, sf_dir):
    return output.lines(_notes(spark, render.parts(spark, sf_dir)).records(), ["_name", "tags", "colour"], "yaml")


@_register("output_table", "SELECT 'E' || lpad(event_id::VARCHAR, 9, '0') AS c0, event_type AS c1, 'k: ' || CAST(props->>'k' AS VARCHAR) AS c2 FROM events")
def output_table(spark, sf_dir):
    records = _notes(spark, render.events(spark, sf_dir)).records()
    return records.df.select(*output.table_cells(records, ["_name", "kind", "props"]))


# --- typed tables ---------------------------------------------------------------------


@_register("table_where", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND (l_discount > 0.08 OR l_shipdate < TIMESTAMP '1996-01-01')")
def table_where(spark, sf_dir):
    rows = from_table(render.table(spark, sf_dir, "lineitem")).where("l_returnflag = R", "l_quantity >= 45", "l_discount > 0.08 || l_shipdate < 1996-01-01 00:00:00")
    return rows.select("l_orderkey, l_linenumber, l_quantity")


@_register("table_words", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' AND NOT p_brand LIKE 'Brand#1%' AND CAST(p_size AS VARCHAR) LIKE '%5'")
def table_words(spark, sf_dir):
    return from_table(render.table(spark, sf_dir, "part")).where("p_name contains ring", "p_brand !startswith Brand#1", "p_size endswith 5").select(["p_partkey", "p_name"])


@_register("table_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 40")
def table_sort_limit(spark, sf_dir):
    rows = from_table(render.table(spark, sf_dir, "orders"), order=["o_orderkey"]).where("o_orderpriority = 1-URGENT")
    return rows.sorted("o_totalprice", descending=True, limit=40).select(["o_orderkey", "o_totalprice"])


@_register("table_count", "SELECT count(*) AS n FROM lineitem WHERE l_tax <> 0.04 AND l_linestatus = 'O'")
def table_count(spark, sf_dir):
    return from_table(render.table(spark, sf_dir, "lineitem")).where("l_tax != 0.04", "l_linestatus = O").count()
