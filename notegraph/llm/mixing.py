"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's share p of all tokens becomes the weight p^a / sum of p^a.  The exponent a
is bisected in [0, 1] (24 halvings): the largest a whose weights reach a target
entropy (as a share of the most possible), or the smallest a with which no source is
repeated more than a limit.  Weights times the token budget are the sources' budgets.
They are realised as permutations in blocks: a block is one pass over a source in the
order of md5(seed:block:doc_id); a budget takes as many full blocks as fit, and of the
next one the documents in order while their tokens fit.

Tokens are runs of characters other than the six ASCII white-space ones.  The cut of
the last block is found from sums over 4096 key ranges of each source, then inside one
range, so that no source is ever ordered in one task.  Only sums reach the driver.

Defined cases: a null source is a source of its own; a source without tokens has
weight 0 and is left out; a document without tokens goes with each full block, and in
the last one up to the cut; repeated rows are taken or left together, as are rows with one
key; null texts have no tokens; a very long text counts as any other, and is left out of
the last block where it doesn't fit, as are the documents after it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, materialise

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS, WAYS = 6, 16  # 16 parts, 6 times: 24 halvings


@dataclass(frozen=True)
class Mix:
    """Either ``entropy`` (share of the most possible) or ``repetition`` (passes at most) is set."""

    entropy: float | None = 0.95
    repetition: float | None = None
    budget: int | None = None  # tokens; as many as there are if None
    seed: str = "mix"


def order_key(seed: str, block: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), block.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def exponent(totals: DataFrame, tokens: int, mix: Mix) -> float:
    """The exponent in [0, 1] for ``totals`` (source, tokens); each round sums 15 candidates at once."""
    share = F.col("tokens") / F.lit(float(tokens))

    def goes_on(a: float) -> Column:
        """Whether the condition on the lower side of the exponent holds at ``a``."""
        power = F.pow(share, F.lit(a))
        if mix.entropy is not None:
            entropy = F.log(F.sum(power)) - F.lit(a) * F.sum(power * F.log(share)) / F.sum(power)
            return entropy >= F.lit(mix.entropy) * F.log(F.count("*").cast("double"))
        budget = float(mix.budget if mix.budget is not None else tokens)
        return F.max(power / share) / F.sum(power) * F.lit(budget / tokens) > F.lit(mix.repetition)

    if totals.agg(goes_on(1.0)).first()[0]:
        return 1.0
    low, width = 0.0, 1.0
    for _ in range(ROUNDS):
        width /= WAYS
        flags = totals.agg(*[goes_on(low + i * width) for i in range(1, WAYS)]).first()
        low += width * sum(1 for x in flags if x)
    return low if mix.entropy is not None else min(1.0, low + width)


def plan(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, weight, budget, blocks (full ones), cut (the last key taken of the next block)."""
    totals = materialise(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"), "mix-totals", sizes.count())
    n = totals.count()  # sources
    tokens = totals.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return totals.select("source", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(0).cast("long").alias("blocks"), F.lit("").alias("cut"))
    a = exponent(totals, tokens, mix)
    share = F.pow(F.col("tokens") / F.lit(float(tokens)), F.lit(a))
    scale = totals.agg(F.sum(share)).first()[0]
    weight = share / F.lit(scale)
    budget = F.round(weight * F.lit(float(mix.budget if mix.budget is not None else tokens))).cast("long")
    budgets = totals.select("source", "tokens", weight.alias("weight"), budget.alias("budget")).withColumn("blocks", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("rest", F.col("budget") - F.col("blocks") * F.col("tokens"))
    budgets = materialise(budgets, "mix-budgets", n)
    named = budgets.withColumnRenamed("source", "own")
    keyed = sizes.join(named, F.col("source").eqNullSafe(F.col("own"))).select("source", "n_tokens", "rest", order_key(mix.seed, F.col("blocks")).alias("key")).withColumn("range", F.substring("key", 1, 3))
    sums = keyed.groupBy("source", "rest", "range").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")
    cut_range = sums.withColumn("before", before).filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).select(F.col("source").alias("cut_source"), F.col("range").alias("cut_range"), "before")
    cut_range = materialise(cut_range, "mix-cuts", n)
    inside = keyed.join(cut_range, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("range") == F.col("cut_range")))
    # Rows with one key are peers of the window's range, so they fit together or not at all.
    fits = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key"))).filter("upto <= rest")
    last = fits.groupBy("source").agg(F.max("key").alias("last")).select(F.col("source").alias("last_source"), "last")
    cuts = cut_range.join(last, F.col("cut_source").eqNullSafe(F.col("last_source")), "left").select("cut_source", F.coalesce("last", "cut_range").alias("cut"))
    return materialise(budgets.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").select("source", "weight", "budget", "blocks", F.coalesce("cut", F.lit("")).alias("cut")), "mix-plan", n)


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))


def realise(rows: DataFrame, planned: DataFrame, mix: Mix) -> DataFrame:
    """The rows (doc_id, source, ...) as often as their source's plan takes them.

    Adds ``block`` and ``order_key``; sorting a source by both gives its stream.
    """
    named = planned.select(F.col("source").alias("own"), "blocks", "cut")
    taken = F.col("blocks") + (order_key(mix.seed, F.col("blocks")) <= F.col("cut")).cast("long")
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("own"))).withColumn("taken", taken).filter("taken > 0")
    return joined.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1))).withColumn("order_key", order_key(mix.seed, F.col("block"))).drop("own", "blocks", "cut", "taken")


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, n_tokens, block, order_key of each document taken, once for each block."""
    sizes = keep(sizes_of(docs))
    return realise(sizes, plan(sizes, mix), mix)


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mixture takes them; texts aren't shuffled."""
    planned = plan(keep(sizes_of(docs)), mix)
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return realise(packed, planned, mix).select("row.*")
