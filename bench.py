"""Benchmark: prints one JSON line with the seconds of each query.

Notes rendered from the tables at ``$BENCH_SF_DIR`` are written once as tables of texts
(not timed).  Two kinds of query run over 700, 10,000 and 50,000 notes: by frontmatter
and by link graph, the kinds for which there are published figures; over 10,000 also from
files.  The registered
headline queries run over the whole tables.  Each query runs once to warm up (its time
is in ``first``) and then three times; ``queries`` has the medians, ``value`` their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from notegraph import queries  # noqa: E402
from notegraph.sources import render  # noqa: E402
from notegraph.vault import Notes, Vault  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
HEADLINES = ["where_and_of_or", "where_contains_list", "sort_limit", "fields_profile", "tags_count", "count_graph", "backlink_hubs", "orphans", "links_to_where", "unresolved_all", "traverse_both", "schema_validate", "schema_infer", "update_plan", "output_json", "table_where", "table_sort_limit", "table_count"]


def main() -> None:
    began = time.time()
    work = tempfile.mkdtemp(prefix="notegraph-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{work}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    session_s = time.time() - began

    cases = {}
    everything = render.orders(spark, SF_DIR).unionByName(render.customers(spark, SF_DIR))
    for n, label in ((700, "700"), (10_000, "10k"), (50_000, "50k")):
        path = f"{work}/notes-{label}"
        # Customers make up a tenth, so that order notes have notes to link to.
        customers, orders = (everything.filter(everything["path"].startswith(p)).orderBy("path").limit(k) for p, k in (("customers/", n // 10), ("orders/", n - n // 10)))
        customers.unionByName(orders).repartition(max(1, min(int(CPUS), n // 1000))).write.parquet(path)
        read = lambda path=path: Notes.of_texts(spark.read.schema("path string, content string").parquet(path))
        cases[f"frontmatter_{label}"] = lambda read=read: read().query(["status = F", "totalprice > 100000"], sort="totalprice", desc=True, limit=20).select("_name, status, totalprice")
        cases[f"graph_{label}"] = lambda read=read: read().query(["_backlink_count > 0"], sort="_backlink_count", desc=True, limit=20, fields=["_backlink_count"]).select("_name, _backlink_count")
        if label == "10k":  # the same notes as files: listed, read and parsed on each run
            root = f"{work}/vault"
            for r in spark.read.parquet(path).toLocalIterator():
                file = Path(root, r["path"])
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_text(r["content"])
            Path(root, ".obsidian").mkdir()
            files = lambda root=root: Vault(spark, root).whole()
            cases["frontmatter_files_10k"] = lambda: files().query(["status = F", "totalprice > 100000"], sort="totalprice", desc=True, limit=20).select("_name, status, totalprice")
            cases["graph_files_10k"] = lambda: files().query(["_backlink_count > 0"], sort="_backlink_count", desc=True, limit=20, fields=["_backlink_count"]).select("_name, _backlink_count")
    cases |= {name: lambda query=queries.QUERIES[name]: query(spark, SF_DIR) for name in HEADLINES}

    seconds, first = {}, {}
    for name, build in cases.items():
        took = []
        for _ in range(RUNS + 1):
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        first[name], seconds[name] = round(took[0], 3), round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "first": first, "session_start": round(session_s, 2), "sf": os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf"), "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
