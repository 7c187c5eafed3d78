"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches, keep, materialise

__all__ = ["bound_batches", "bounded_sample", "held_out", "identity", "keep", "materialise", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identity(text: str = "text") -> list[Column]:
    """Two longs, ``text_1`` and ``text_2``, that with the doc_id tell rows of different texts apart."""
    return [F.xxhash64(text).alias("text_1"), F.xxhash64(F.lit("second"), text).alias("text_2")]


def bounded_sample(df: DataFrame, by: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """About ``per_class`` rows for each value of ``by``, chosen by a hash of ``key``.

    Classes with fewer rows are kept whole.  It serves only to fit classifiers:
    the bound is a parameter of each operator that uses it.
    """
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).count().collect()
    if not counts:
        return df.limit(0)
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, per_class / r[1])))])
    dice = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return df.filter(F.col(by).isNotNull() & (dice < F.element_at(share, F.col(by))))
