"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node reachable) of all nodes of the edges a-b but the least ones."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (root[left] != root[right]).any():
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(shorter := root[root], root):
            root = shorter
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges becomes its spanning stars: no more rows, the same components."""
    for batch in batches:
        if len(batch):
            node, least = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge in ``edges`` (a, b; longs).

    ``component`` is the least node reachable.  Large-star links each node's larger
    neighbours to its least neighbour, small-star the smaller ones; both keep the
    components, and the rounds end when nothing changes, after about the logarithm of the
    edges' number.  Each round is a written
    table in the shared folder.  A centre that many nodes hang on is never collected:
    its minimum is pre-aggregated, and the join back on it can be split by Spark.
    """
    now = materialise(edges.select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    state, n = None, now.count()
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(small_least, F.col("a") == F.col("k"))
        now = materialise(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "edges", n)
        summed = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if summed == state:
            break
        state = summed
    own = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)
