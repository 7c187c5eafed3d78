"""The shared folder and tables written once."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from notegraph.errors import NoteError
from notegraph.session import clear, keep, mark, materialise, own_folder, shared_folder


def test_written_tables_stay_until_cleared(spark):
    df = spark.range(5).select("id", F.rand().alias("x"))
    once = materialise(df, "t")
    assert sorted(once.collect()) == sorted(once.collect()) and once.schema.simpleString() == df.schema.simpleString()
    assert own_folder(spark).startswith(shared_folder(spark)) and os.listdir(own_folder(spark))
    assert materialise(spark.range(0), "none").collect() == []
    clear(spark)
    assert not os.path.exists(own_folder(spark))


def test_kept_results_are_computed_once(spark):
    kept = keep(spark.range(5).select("id", F.rand().alias("x")))
    assert sorted(kept.collect()) == sorted(kept.collect()) and kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    clear(spark)
    assert not kept.storageLevel.useDisk


def test_parts_are_cleared_between_marks(spark):
    first = materialise(spark.range(3), "first")
    begun = mark(spark)
    inner, kept = materialise(spark.range(4), "inner"), keep(spark.range(5))
    result = materialise(inner.union(kept), "result")
    clear(spark, begun, mark(spark) - 1)
    assert first.count() == 3 and result.count() == 9 and mark(spark) == begun + 1 and not kept.storageLevel.useDisk
    assert len(os.listdir(own_folder(spark))) == 2
    clear(spark)
    assert not os.path.exists(own_folder(spark)) and mark(spark) == 0


def test_a_cluster_needs_the_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    far = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(NoteError):
        shared_folder(far)
