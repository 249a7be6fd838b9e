"""The registered queries against SQL on another engine, and the shape of their plans."""

import pytest
from check import connect, differences

import __spark_entry__ as entry
from stayline.checks import queries
from stayline.checks.oracle import all_sql

SQL = all_sql()
QUERIES = queries.all_queries()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_sql_names_a_query():
    assert set(SQL) <= set(QUERIES)
    without = set(QUERIES) - set(SQL)
    assert all(n.startswith(("train_", "model_", "score_trained", "elbow", "feature_imp",
                             "performance")) for n in without)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result_as_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    assert differences(df.toPandas(), duck.execute(SQL[name]).fetchdf()) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                     "BroadcastNestedLoopJoin"):
        assert operator not in plan


@pytest.mark.parametrize("name", [
    "retention_report", "retention_topn_revenue", "retention_topn_prob", "top10_risk",
    "dashboard_records"])
def test_top_lists_keep_n_rows_per_task(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_unused_branches_stay_out(spark, folder):
    plan = QUERIES["clv_metrics"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "events" not in plan


def test_segment_lookup_is_a_broadcast(spark, folder):
    plan = QUERIES["segment_lookup"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [Cluster" in plan


def test_order_filter_reaches_the_scan(spark, folder):
    plan = QUERIES["churn_status"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate,2000-01-01T00:00)" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["retention_report", "dashboard_records"])
def test_late_columns_read_only_the_listed_customers(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "p_type" in plan
    assert "LeftSemi, (o_custkey" in plan and "LeftSemi, (c_custkey" in plan
