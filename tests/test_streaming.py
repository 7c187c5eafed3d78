"""Notes as a stream."""

import datetime as dt

import pytest

from notegraph.errors import InvalidPredicate
from notegraph.streaming.notes import TEXTS, matching, read_stream, tag_counts


def batch(spark, folder, rows):
    spark.createDataFrame(rows, TEXTS).coalesce(1).write.mode("append").parquet(folder)


def test_filter_and_windowed_tags(spark, tmp_path):
    folder = str(tmp_path / "in")
    note = lambda tags, extra="": "---\ntags:\n" + "".join(f"  - {t}\n" for t in tags) + extra + "---\n"
    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    batch(spark, folder, [("a.md", note("xy", "n: 1\n"), day(1)), ("b.md", note("x", "n: 20\n"), day(1, 5)), ("c.md", "---\n: [\n---\n", day(1))])
    query = matching(read_stream(spark, folder), ["n > 3"]).df.select("name").writeStream.format("memory").queryName("big").option("checkpointLocation", str(tmp_path / "c1")).start()
    counts = tag_counts(read_stream(spark, folder)).writeStream.outputMode("append").format("memory").queryName("tags").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable(), counts.processAllAvailable()
    batch(spark, folder, [("d.md", note("x", "n: 4\n"), day(5))])
    query.processAllAvailable(), counts.processAllAvailable()
    batch(spark, folder, [("late.md", note("x"), day(1)), ("e.md", note("z"), day(9))])
    query.processAllAvailable(), counts.processAllAvailable()
    query.stop(), counts.stop()
    assert sorted(r[0] for r in spark.table("big").collect()) == ["b", "d"]
    got = {(r["window_start"].day, r["tag"]): r["n"] for r in spark.table("tags").collect()}
    assert got[(1, "x")] == 2 and got[(1, "y")] == 1  # the late note is not counted
    with pytest.raises(InvalidPredicate):
        matching(read_stream(spark, folder), ["_link_count = 1"])
