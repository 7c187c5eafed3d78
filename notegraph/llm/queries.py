"""The registered queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, langid, mixing, quality, secrets, simhash, tokens, urls
from .common import held_out, table

PLANTED = r"\### Assistant: </turn> ok"
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return chat.read_back(chat.format_turns(rows.union(extra))).drop("escaped_turns")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    numbered = pages.select("url", F.regexp_extract(urls.path_of(F.col("url")), r"/(\d+)", 1).try_cast("long").alias("named_id"))
    labelled = numbered.join(labels.select("doc_id", "quality"), F.col("named_id") == F.col("doc_id")).select("url", (F.col("quality") == 0).alias("bad"))
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in URL_RULES])))
    return urls.judge(pages, rules, urls.mine_rules(labelled))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return docs.select("doc_id", held_out().alias("held_out"), langid.predict(model, docs).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label")))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality.score(model, docs).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_exact_dedup, op3_url_filter, op4_language_id, op5_secret_scan, op6_quality, op7_token_files, op8_simhash, op9_mixing, op10_decontamination)}

_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), sized AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '[\\#<\n]')) AS role_chars,
    CASE WHEN NOT (contains(text, '###') OR contains(text, '</turn>') OR regexp_matches(text, '\\[\\#<]')) THEN length(text)
         WHEN NOT regexp_matches(text, '(^|[^#])(###)+##?($|[^#])') THEN length(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '###')) + len(regexp_extract_all(text, '</turn>'))
         ELSE length(text) + len(regexp_extract_all(text, '[\\#<]')) END AS body_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + role_chars + body_chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP2 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), ranked AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
"""

_OP9 = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), totals AS (
  SELECT source, sum(n_tokens) AS tokens FROM sizes GROUP BY source HAVING sum(n_tokens) > 0
), shares AS (
  SELECT list(tokens / (SELECT sum(tokens) FROM totals)::DOUBLE ORDER BY source) AS ps FROM totals
), bisect(step, low, width, ps) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, ps FROM shares
  UNION ALL
  SELECT step + 1,
    low + CASE WHEN ln(list_sum(list_transform(ps, lambda p: pow(p, low + width / 2)))) - (low + width / 2) * list_sum(list_transform(ps, lambda p: pow(p, low + width / 2) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, low + width / 2))) >= 0.95 * ln(len(ps)) THEN width / 2 ELSE 0 END,
    width / 2, ps
  FROM bisect WHERE step < 24
), alpha AS (
  SELECT CASE WHEN ln(list_sum(ps)) - list_sum(list_transform(ps, lambda p: p * ln(p))) / list_sum(ps) >= 0.95 * ln(len(ps)) THEN 1.0 ELSE low END AS a FROM bisect WHERE step = 24
), powered AS (
  SELECT source, tokens, pow(tokens / (SELECT sum(tokens) FROM totals)::DOUBLE, (SELECT a FROM alpha)) AS q FROM totals
), budgets AS (
  SELECT source, tokens, CAST(round(q / (SELECT sum(q) FROM powered) * (SELECT sum(tokens) FROM totals)) AS BIGINT) AS budget FROM powered
), blocks AS (
  SELECT source, CAST(budget // tokens AS BIGINT) AS blocks, CAST(budget % tokens AS BIGINT) AS rest FROM budgets
), keyed AS (
  SELECT s.*, b.blocks, b.rest, sum(n_tokens) OVER (PARTITION BY s.source ORDER BY md5(concat_ws(':', 'mix', b.blocks, coalesce(CAST(doc_id AS VARCHAR), '')))) AS upto
  FROM sizes s JOIN blocks b ON s.source IS NOT DISTINCT FROM b.source
), taken AS (
  SELECT *, blocks + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM keyed
)
SELECT doc_id, source, n_tokens, block, md5(concat_ws(':', 'mix', block, coalesce(CAST(doc_id AS VARCHAR), ''))) AS order_key
FROM (SELECT doc_id, source, n_tokens, CAST(unnest(range(n)) AS BIGINT) AS block FROM taken)
"""

_OP10 = r"""
WITH masks AS MATERIALIZED (
  SELECT mask, length(mask) AS span, list_filter(range(length(mask)), lambda p: mask[p + 1] = '1') AS places
  FROM (VALUES %s) AS m(mask)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), i AS MATERIALIZED (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
), item_seeds AS (
  SELECT q, spot, mask, array_to_string(list_transform(places, lambda p: w[spot + p + 1]), ' ') AS seed
  FROM (SELECT q, w, mask, places, unnest(range(len(w) - span + 1)) AS spot FROM i JOIN masks ON CASE WHEN len(w) >= %d THEN span >= %d ELSE span = len(w) END)
), doc_seeds AS (
  SELECT r, spot, mask, array_to_string(list_transform(places, lambda p: w[spot + p + 1]), ' ') AS seed
  FROM (SELECT r, w, mask, places, unnest(range(len(w) - span + 1)) AS spot FROM d JOIN masks ON len(w) >= span AND mask IN (SELECT mask FROM item_seeds))
), hits AS (
  SELECT DISTINCT r, q, s.spot - t.spot AS g FROM doc_seeds s JOIN item_seeds t ON s.mask = t.mask AND s.seed = t.seed
), compared AS (
  SELECT r, q, g, k, n, x = y AS alike FROM (
    SELECT r, q, g, k, n, d.w[g + k + 1] AS x, i.w[k + 1] AS y
    FROM (SELECT h.r, h.q, g, len(i.w) AS n, unnest(range(len(i.w))) AS k FROM hits h JOIN i ON h.q = i.q) JOIN d USING (r) JOIN i USING (q)
    WHERE g + k >= 0 AND g + k < len(d.w))
), summed AS (
  SELECT *, sum(CASE WHEN alike THEN 1 ELSE -2 END) OVER (PARTITION BY r, q, g ORDER BY k) AS upto FROM compared
), stretches AS (
  SELECT *, upto - least(0, min(upto) OVER (PARTITION BY r, q, g ORDER BY k)) AS stretch FROM summed
), scored AS (
  SELECT r, q, g, n, CAST(max(stretch) AS INTEGER) AS score, count(*) FILTER (WHERE alike) AS equal FROM stretches GROUP BY r, q, g, n
), ranked AS (
  SELECT doc_id, item_id, score, CAST(g AS INTEGER) AS diagonal, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, g) AS nth
  FROM scored JOIN d USING (r) JOIN i USING (q) WHERE score >= %d OR equal * 5 >= n * 4
)
SELECT doc_id, item_id, score, diagonal FROM ranked WHERE nth = 1
""" % (", ".join(f"('{m}')" for m in (*decontam.MASKS, decontam.LONG, *["1" * n for n in range(1, decontam.SPAN)])), decontam.SPAN, decontam.SPAN, decontam.LEAST)

ORACLE_SQL = {"op1_chat_format": _OP1, "op2_exact_dedup": _OP2, "op9_mixing": _OP9, "op10_decontamination": _OP10}
