"""Each query that has SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from pagelore.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_plans_prune_and_push_down(spark, data):
    plan = QUERIES["text_score_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    stats = QUERIES["latency_stats"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in stats


def test_results_do_not_depend_on_partitions(spark, data):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    few = {n: sorted(map(str, QUERIES[n](spark, data).collect())) for n in ("nms", "dedupe_regions", "line_clusters", "reading_order", "ctc_decode", "scheduler_replay")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    for n, rows in few.items():
        assert sorted(map(str, QUERIES[n](spark, data).collect())) == rows
    spark.conf.set("spark.sql.shuffle.partitions", "4")
