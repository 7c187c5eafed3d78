"""URL filter: explicit rules, then association rules mined from labelled URLs.

Explicit rules are (action, host, path prefix); a rule fits its host and all
subdomains if the path starts with its path, and the longest rule wins.  A host is looked
up by its last labels only, as many as the longest rule host has.

URLs that no rule fits are judged by association rules.  Tokens that always occur
together in the labelled URLs are one item, and such that all of them hold are none, so
that itemsets don't multiply over words that say the same.  FP-growth mines the itemsets
of the URLs with a bad label alone; their support among all labelled URLs, counted by the
same index that judges pages, gives confidence.  Rules are pruned by support, by
confidence, and by a test that the confidence exceeds the share of bad labels by more than
the luckiest of all itemsets would, which can be met at any share.  An inverted index from each rule's rarest item, under every token
of that item, finds the rules of a URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
no tokens, fits no rule and is allowed; a very long URL is judged whole, but of its host
only the last ``DOMAIN_LABELS`` labels make domain tokens; of rules that tie in length the
greater by text, then by action, wins; repeated rows are judged alike, and count as often
as they stand when labelled; without labelled rows nothing is mined; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host's last labels that are tokens.
DOMAIN_LABELS = 4


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST_PATH, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, HOST_PATH, 2), F.lit(""))


def host_suffixes(host: Column, labels: int) -> Column:
    """The last 1 to ``labels`` labels of the host, as an array of texts; time linear in the host's length."""
    return F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(1, labels + 1)]))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host words, domain suffixes, path words, query keys, scheme and file ending.

    Numbers are left out, for they name a page and not a kind of page.
    """
    host, path = host_of(url), path_of(url)
    words = lambda tag, text: F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike(r"^\d+$")), lambda w: F.concat(F.lit(tag), F.lower(w)))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)(?:=[^&]*)?"), 1)
    parts = F.concat(
        words("host:", host),
        F.transform(F.filter(host_suffixes(host, DOMAIN_LABELS), lambda h: h != ""), lambda h: F.concat(F.lit("domain:"), h)),
        words("path:", path),
        F.transform(keys, lambda k: F.concat(F.lit("query:"), F.lower(k))),
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
    )
    return F.when(url.contains("://"), F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


_RULES = "antecedent array<string>, items array<array<string>>, key string, confidence double, lift double, support double"


def _classes(rows: DataFrame, least: float, total: int) -> DataFrame:
    """token, item, n: tokens of at least ``least`` rows, each with the first token of those that occur in the same rows.

    Tokens with one count of rows and one sum of the rows' hashes stand in the same rows.
    """
    tokens = rows.select(F.explode("tokens").alias("token"), F.xxhash64("row").cast("decimal(38,0)").alias("hash"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"), F.sum("hash").alias("rows")).filter((F.col("n") >= least) & (F.col("n") < total))
    firsts = counted.groupBy("n", "rows").agg(F.min("token").alias("item"))
    return materialise(counted.join(firsts, ["n", "rows"]).select("token", "item", "n"), "url-classes")


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, chance: float = 0.01) -> DataFrame:
    """Rules from ``labelled`` (url, bad boolean): antecedent (an item's first tokens), items (all
    tokens of each item), key (a token of the rarest item), confidence, lift, support.

    Their number depends on the support bound and not on the number of rows.
    ``chance``: the chance, at most, that any rule passes where labels don't depend on URLs;
    Chernoff's bound on a rule's bad rows, times the number of itemsets tried.
    """
    rules = candidate_rules(labelled, min_support)
    tried = rules.count()
    c, base = F.col("confidence"), F.col("base")
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
    bound = F.col("n") * (part(c, base) + part(1 - c, 1 - base))
    passed = (c >= min_confidence) & (c > base) & (bound >= math.log(max(tried, 1) / chance))
    return rules.filter(passed).select("antecedent", "items", F.explode("keys").alias("key"), "confidence", "lift", "support")


def candidate_rules(labelled: DataFrame, min_support: float = 0.002) -> DataFrame:
    """All itemsets of the bad URLs with ``min_support``, before they are pruned: antecedent, items, keys, n, n_bad, base, confidence, lift, support."""
    spark = labelled.sparkSession
    empty = "antecedent array<string>, items array<array<string>>, keys array<string>, n long, n_bad long, base double, confidence double, lift double, support double"
    rows = labelled.filter(F.col("url").contains("://") & F.col("bad").isNotNull()).select("url", "bad", url_tokens(F.col("url")).alias("tokens"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    total, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not n_bad:
        return spark.createDataFrame([], empty)
    least = min_support * total
    classes = _classes(rows, least, total)
    named = rows.select("row", "bad", F.explode("tokens").alias("token")).join(classes.select("token", "item"), "token")
    items = materialise(named.groupBy("row", "bad").agg(F.collect_set("item").alias("tokens")), "url-items")
    bad = items.filter("bad")
    if bad.isEmpty():
        return spark.createDataFrame([], empty)
    sets = FPGrowth(itemsCol="tokens", minSupport=min(1.0, least / n_bad)).fit(bad).freqItemsets
    size = classes.filter("token = item").select(F.col("item").alias("key"), F.col("n").alias("key_n"))
    sets = materialise(sets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n_bad")).withColumn("rule_id", F.xxhash64("antecedent")), "url-sets")
    rarest = sets.select("rule_id", F.explode("antecedent").alias("key")).join(size, "key").groupBy("rule_id").agg(F.min_by("key", F.struct("key_n", "key")).alias("key"))
    keyed = materialise(sets.join(rarest, "rule_id"), "url-keyed")
    seen = items.withColumn("key", F.explode("tokens")).join(keyed.select("rule_id", "antecedent", "key"), "key").filter(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("rule_id").agg(F.count("*").alias("n"))
    members = classes.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("members"))
    whole = keyed.select("rule_id", F.explode("antecedent").alias("item")).join(members, "item").groupBy("rule_id").agg(F.collect_list(F.struct("item", "members")).alias("of"))
    base = n_bad / total
    found = keyed.join(seen, "rule_id").join(whole, "rule_id")
    confidence = F.col("n_bad") / F.col("n")
    of = F.array_sort("of")
    return materialise(found.select("antecedent", F.transform(of, lambda x: x["members"]).alias("items"), F.element_at(F.filter(of, lambda x: x["item"] == F.col("key")), 1)["members"].alias("keys"), "n", "n_bad", F.lit(base).alias("base"), confidence.alias("confidence"), (confidence / F.lit(base)).alias("lift"), (F.col("n_bad") / F.lit(float(total))).alias("support")), "url-rules")


def judge(pages: DataFrame, rules: DataFrame, mined: DataFrame, key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for each row of ``pages`` (page_id, url).

    ``rules``: (action, host, path).  Both rule tables are joined by equality on a
    host suffix or a token; Spark broadcasts them only if they are small.
    """
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    rows = pages.select(F.col(key).alias("page_id"), F.col("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = rows.select("url", "host", "path").distinct()
    fits = (
        urls.select("url", "path", F.explode(host_suffixes(F.col("host"), labels)).alias("suffix"))
        .join(rules.select("action", F.col("host").alias("suffix"), F.col("path").alias("prefix")), "suffix")
        .filter(F.col("path").startswith(F.col("prefix")))
        .groupBy("url")
        .agg(F.max(F.struct((F.length("suffix") + F.length("prefix")).alias("n"), F.concat("suffix", "prefix").alias("rule"), "action")).alias("best"))
        .select(F.col("url").alias("rule_url"), "best.rule", "best.action")
    )
    tokens = url_tokens(F.col("url"))
    hits = (
        urls.select("url", tokens.alias("tokens"))
        .withColumn("key", F.explode("tokens"))
        .join(mined, "key")
        .filter(F.forall("items", lambda members: F.arrays_overlap(members, F.col("tokens"))))
        .groupBy("url")
        .agg(F.max("confidence").alias("confidence"))
        .select(F.col("url").alias("hit_url"), "confidence")
    )
    judged = rows.join(fits, F.col("url") == F.col("rule_url"), "left").join(hits, F.col("url") == F.col("hit_url"), "left")
    verdict = F.coalesce("action", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
