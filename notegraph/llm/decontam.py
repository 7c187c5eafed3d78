"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts become lower-case words (runs of letters and digits).  A seed is the hash of the
words of a window at the fixed positions of a mask; the others are ignored, so a window
still hits where those words were replaced.  Seeds of all windows of all documents join
those of all benchmark windows.  A hit names a diagonal (document position less item
position); along it each word of the item is compared.  The pair is reported if the best
stretch by +1 for an equal and -2 for an unequal word reaches ``least``, or if at least
four fifths of all the item's words are equal.

Any two words of a window are ignored together by one of ``MASKS``.  With ``LONG``, for
three words in the middle of 15 to 17, each passage of ``SPAN`` words or more of which at
most a fifth was replaced, wherever, has a seed hit (the tests try every choice of words).

The benchmark's seeds are broadcast if their number is within ``BROADCAST_SEEDS``;
beyond, Spark shuffles both sides.  Windows are made and probed in one pass over the
documents, and only hits leave it.  Of the texts that were hit, the words' hashes are cut
into pieces of ``PIECE`` words, so that a diagonal costs the item's length and not the
text's.

Items of fewer than ``SPAN`` words are sought whole: at each document position, as many
words as such an item has are hashed (for each length that occurs in the benchmark).
Even an item of one word is found wherever that word stands.

Defined cases: null or empty texts have no words, and so no hits; a very long text is
searched whole, like any other; a null item_id is
reported as null, and items that share an item_id are sought each; repeated rows and rows that share a
doc_id are reported once, by any of their texts, but only rows of a text in which an
item was found are dropped; a null doc_id is reported as null; ties of
diagonals go to the higher score, then the lower diagonal; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identity, materialise

#: Fixed masks: 1 is compared, 0 ignored.  Each pair of positions is ignored by one of
#: the first six; the last two also ignore three words at once.
MASKS = ("1100101100", "0010110110", "1011001010", "0110011001", "0101100011", "1001010101", "1101100111", "1110011011")
LONG = "111110000011111"
SPAN = 10
LEAST = 10
#: Two longs and an int for each seed: at most about 100 MB in memory.
BROADCAST_SEEDS = 1_000_000
#: Words of a piece of a text that was hit.
PIECE = 64


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.transform(words, lambda w: F.xxhash64(w))


def windows(df: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """A row (*keep, at, seed) for each window and mask of ``df`` (*keep, h)."""
    least = min(map(len, masks))
    # A text too short for any window gives no start; a filter on its size would hash its words a second time.
    last = F.size("h") - least
    starts = df.select(*keep, "h", F.explode(F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))).alias("at"))

    def seed(mask: str) -> Column:
        hashed = F.xxhash64(F.lit(mask), *[F.get("h", F.col("at") + i) for i, x in enumerate(mask) if x == "1"])
        return hashed if len(mask) == least else F.when(F.col("at") + len(mask) <= F.size("h"), hashed)

    return starts.select(*keep, "at", F.explode(F.array(*map(seed, masks))).alias("seed")).filter("seed is not null")


def scored(equal: Column) -> Column:
    """Of a text of 1 and 0 (words that are equal or not along a diagonal), the best stretch and the number of equal ones."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("equal"))

    def step(acc: Column, x: Column) -> Column:
        now = F.greatest(F.lit(0), acc["now"] + F.when(x == "1", F.lit(1)).otherwise(F.lit(-2)))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"), (acc["equal"] + (x == "1").cast("int")).alias("equal"))

    return F.aggregate(F.split(equal, ""), start, step, lambda acc: F.struct(acc["best"].alias("score"), acc["equal"].alias("equal")))


_KEY = ("hit_id", "hit_1", "hit_2")


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """hit_id, hit_1, hit_2, hit_item, hit_words, n, diagonal: each diagonal on which a seed hits, once; n is the item's length."""
    long, of_item = [*MASKS, LONG], ["item_id", "words", "n"]
    lengths = sorted(r[0] for r in items.select("n").distinct().filter(F.col("n").between(1, SPAN - 1)).collect())
    seeds = windows(items.filter(F.col("n") >= SPAN), of_item, long)
    for n in lengths:
        seeds = seeds.union(windows(items.filter(F.col("n") == n), of_item, ["1" * n]))
    seeds = materialise(seeds.distinct().withColumnRenamed("at", "item_at"), "seeds", 100 * items.count())
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    hashed = docs.select(F.col("doc_id").alias("hit_id"), *[x.alias(n) for x, n in zip(identity(), _KEY[1:])], word_hashes(F.col("text")).alias("h"))
    probes = windows(hashed, list(_KEY), ["1" * n for n in lengths] + long)
    hits = probes.join(seeds, "seed").select(*_KEY, F.col("item_id").alias("hit_item"), F.col("words").alias("hit_words"), "n", (F.col("at") - F.col("item_at")).alias("diagonal"))
    return materialise(hits.distinct(), "seed-hits", docs.count())


def _scored(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """doc_id, text_1, text_2, item_id, diagonal, score of each diagonal accepted.

    The words' hashes of each text that was hit are cut into pieces of ``PIECE`` words once; a
    diagonal meets only the pieces that it crosses, however long the text and however many
    diagonals it has.
    """
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h"))
    items = materialise(items.select("item_id", "h", F.xxhash64("h").alias("words"), F.size("h").alias("n")).filter("n > 0").distinct(), "items", benchmark.count())
    hits = _hits(docs, items)
    same_text = lambda t, i: t["doc_id"].eqNullSafe(i["hit_id"]) & (t["text_1"] == i["hit_1"]) & (t["text_2"] == i["hit_2"])
    rows, hit = docs.select("doc_id", *identity(), "text"), hits.select(*_KEY).distinct()
    texts = rows.join(hit, same_text(rows, hit), "left_semi").select("doc_id", "text_1", "text_2", word_hashes(F.col("text")).alias("words_of_text"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words_of_text") - 1, F.lit(0)), F.lit(PIECE)), lambda at: F.slice("words_of_text", at + 1, F.lit(PIECE)))
    pieces = texts.select("doc_id", "text_1", "text_2", F.posexplode(cut).alias("piece", "part"))
    first, last = F.greatest(F.col("diagonal"), F.lit(0)), F.col("diagonal") + F.col("n") - 1
    crossed = hits.filter(last >= 0).select("*", F.explode(F.sequence(F.floor(first / PIECE).cast("int"), F.floor(last / PIECE).cast("int"))).alias("crossed"))
    placed = pieces.join(crossed, same_text(pieces, crossed) & (F.col("piece") == F.col("crossed")))
    placed = placed.join(items.drop("n"), F.col("hit_item").eqNullSafe(F.col("item_id")) & (F.col("hit_words") == F.col("words")))
    begin = F.greatest(F.col("piece") * PIECE, first)
    length = F.least(F.col("piece") * PIECE + F.size("part"), last + 1) - begin
    alike = F.zip_with(F.slice("part", begin - F.col("piece") * PIECE + 1, length), F.slice("h", begin - F.col("diagonal") + 1, length), lambda a, b: F.when(a == b, "1").otherwise("0"))
    parts = placed.filter(length > 0).select("doc_id", "text_1", "text_2", "item_id", "words", "n", "diagonal", "piece", F.array_join(alike, "").alias("alike"))
    # Repeated rows of a text give the same parts, which the set holds once.
    along = parts.groupBy("doc_id", "text_1", "text_2", "item_id", "words", "n", "diagonal").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("piece", "alike"))), lambda p: p["alike"]), "").alias("alike"))
    found = along.withColumn("s", scored(F.col("alike")))
    return found.filter((F.col("s.score") >= least) | (F.col("s.equal") * 5 >= F.col("n") * 4)).select("doc_id", "text_1", "text_2", "item_id", "diagonal", "s.score")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, score, diagonal: each pair of a document and an item found in it, once."""
    best = _scored(docs, benchmark, least).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("diagonal")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.back")).alias("diagonal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found."""
    found = _scored(docs, benchmark, least).select(F.col("doc_id").alias("found_id"), F.col("text_1").alias("found_1"), F.col("text_2").alias("found_2")).distinct()
    found = materialise(found, "contaminated", docs.count())
    same = docs["doc_id"].eqNullSafe(found["found_id"]) & (F.xxhash64(docs["text"]) == found["found_1"]) & (F.xxhash64(F.lit("second"), docs["text"]) == found["found_2"])
    return docs.join(found, same, "left_anti")
