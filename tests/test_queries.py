"""Every registered query of the record engine against its SQL."""

import duckdb
import pytest

from notegraph import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def rows(names, values):
    return sorted([tuple(str(v) for _, v in sorted(zip(names, r))) for r in values])


def assert_parsed_once(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    parses = [line for line in plan.splitlines() if "ArrowEvalPython" in line and ("_parse(" in line or "_invalid(" in line)]
    assert len(parses) <= 1 and plan.count("ArrowEvalPython") <= 1 + ("edit(" in plan)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    assert_parsed_once(got)
    wanted = duck.execute(queries.SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, wanted.fetchall())


def test_link_queries_parse_no_frontmatter(spark, sf_dir):
    for name in ("orphans", "links_to", "backlink_hubs"):
        assert "_parse(" not in queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_typed_predicates_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = queries.QUERIES["table_where"](spark, sf_dir)._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters") :]
    assert "EqualTo(l_returnflag,R)" in pushed and "GreaterThanOrEqual(l_quantity,45.0)" in pushed
    assert "l_extendedprice" not in pushed  # only the columns it needs are read
