"""Inputs where one key holds a third of the rows or more: same results, no group in one task."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.operators import evaluate, explore, reports
from stayline.operators.features import split
from stayline.sources.star import customer_view, star_tables

HOT = 7


@pytest.fixture(scope="module")
def skewed(spark, folder):
    """Half of the orders go to one customer, half of the lines to one order and one part."""
    tables = star_tables(spark, folder)
    hot_order = tables("orders").filter("o_orderdate < '1999-01-01'").agg(
        F.min("o_orderkey")).first()[0]

    def read(name):
        df = tables(name)
        if name == "orders":
            return df.withColumn("o_custkey", F.when(
                (F.col("o_orderkey") % 2 == 0) | (F.col("o_orderkey") == hot_order), HOT
            ).otherwise(F.col("o_custkey")))
        if name == "lineitem":
            hot = F.col("l_linenumber") % 2 == 0
            # As many writers as a table of many files would have: a skewed partition
            # is split between the outputs of its writers.
            return df.repartition(16).withColumns({
                "l_orderkey": F.when(hot, hot_order).otherwise(F.col("l_orderkey")),
                "l_partkey": F.when(hot, 1).otherwise(F.col("l_partkey"))})
        if name == "events":
            return df.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, HOT).otherwise(
                F.col("user_id")))
        return df
    return read


@pytest.fixture()
def shuffled_joins(spark):
    """No broadcasts, and skew handling from the first byte on."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_view_with_hot_keys_matches_pandas(spark, skewed, shuffled_joins):
    view = customer_view(skewed)
    got = view.toPandas().set_index("CustomerID").sort_index()
    assert "skew=true" in view._jdf.queryExecution().executedPlan().toString()
    orders = skewed("orders").toPandas()
    prior = orders[orders.o_orderdate < "2000-01-01"]
    lines = skewed("lineitem").toPandas().merge(
        prior, left_on="l_orderkey", right_on="o_orderkey").merge(
        skewed("part").toPandas(), left_on="l_partkey", right_on="p_partkey")
    spent = prior.groupby("o_custkey").o_totalprice.sum() / 50
    assert got.index.tolist() == sorted(spent.index)
    assert (got.TotalSpent - spent).abs().max() < 1e-6
    returns = lines[lines.l_returnflag == "R"].groupby("o_custkey").size()
    some = lines.groupby("o_custkey").size()
    want = returns.reindex(some.index, fill_value=0)
    assert (got.ReturnCount.reindex(some.index) == want).all()
    best = (lines.groupby(["o_custkey", "p_type"]).l_extendedprice.sum().reset_index()
            .sort_values(["o_custkey", "l_extendedprice", "p_type"], ascending=[True, False, True])
            .groupby("o_custkey").p_type.first())
    assert (got.PreferredCategory.reindex(best.index) == best).all()
    events = skewed("events").toPandas()
    errors = events[events.event_type == "error"].groupby("user_id").size()
    assert got.ComplaintHistory[HOT] == min(4, errors.get(HOT, 0) // 5)


def test_hot_scores_and_values(spark, many_ranges):
    """A dominant score, CLV and label: counted before any exchange."""
    n = 6000
    df = spark.range(n).select(
        F.col("id").alias("CustomerID"), (F.col("id") % 5 > 0).cast("int").alias("ChurnRisk"),
        F.when(F.col("id") % 2 == 0, 0.6).otherwise(F.col("id") / n).alias("ChurnProb"),
        F.when(F.col("id") % 3 > 0, 100.0).otherwise(F.col("id").cast("double")).alias("PredCLV"),
        F.lit(1).alias("ChurnPred"))
    frame = df.toPandas()
    kpi = reports.kpi_retention(df).first()
    assert kpi["high_value"] == (frame.PredCLV >= frame.PredCLV.quantile(0.75)).sum()
    ranks = frame.ChurnProb.rank()
    pos = frame.ChurnRisk == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert evaluate.roc_auc(df).first()["auc"] == pytest.approx(auc)
    stats = {r["column"]: r for r in explore.describe_numeric(df, ["PredCLV"]).collect()}
    assert stats["PredCLV"]["p50"] == frame.PredCLV.quantile(0.5)
    assert pd.notna(stats["PredCLV"]["std"])


def test_split_with_repeated_ids_keeps_copies_together(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("CustomerID"),
        F.lit(0).alias("ChurnRisk"))
    parts = split(df, stratify="ChurnRisk")
    assert parts.count() == 3000
    sides = parts.groupBy("CustomerID").agg(F.countDistinct("is_train").alias("n"))
    assert sides.filter("n > 1").count() == 0
