import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayline.operators import explore, order_stats


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_over_many_ranges(spark, many_ranges, descending):
    values = np.random.default_rng(1).permutation(2000)
    df = spark.createDataFrame(pd.DataFrame({
        "g": values % 3, "v": values.astype(float), "a": values % 7, "b": 1}))
    out = order_stats.running_totals(df, "v", ["a", "b"], by=["g"], descending=descending).toPandas()
    assert len(out) == 2000
    for _, part in out.groupby("g"):
        part = part.sort_values("v", ascending=not descending)
        assert (part["cum_a"] == part["a"].cumsum()).all()
        assert (part["cum_b"] == part["b"].cumsum()).all()


def test_rows_really_spread_over_ranges(spark, many_ranges):
    df = spark.range(5000).withColumn("v", F.col("id").cast("double"))
    out = order_stats.running_totals(df.select("v", "id"), "v", ["id"])
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    assert out.agg(F.max("cum_id")).first()[0] == 5000 * 4999 // 2


def test_null_groups_keep_their_rows(spark, many_ranges):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 5)],
                               "g string, v double, n long")
    out = order_stats.running_totals(df, "v", ["n"], by=["g"]).collect()
    assert sorted((r["g"] or "", r["v"], r["cum_n"]) for r in out) == [
        ("", 1.0, 2), ("", 2.0, 5), ("a", 1.0, 5)]


def test_quantiles_with_a_dominant_value(spark, many_ranges):
    rng = np.random.default_rng(2)
    heavy = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000))
    frame = pd.DataFrame({"x": heavy, "y": rng.integers(0, 4, 3000)})
    probs = {"a": 0.0, "b": 0.1, "c": 0.333, "d": 0.75, "e": 1.0}
    got = {r["column"]: r for r in order_stats.exact_quantiles(
        spark.createDataFrame(frame), ["x", "y"], probs).collect()}
    for c in frame:
        for name, p in probs.items():
            assert got[c][name] == pytest.approx(frame[c].quantile(p), abs=1e-12)


@pytest.mark.parametrize("kind", ["outlier", "dominant", "two", "ties"])
def test_quantiles_narrow_their_brackets(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=4000)
    if kind == "outlier":
        x[:2] = 1e300, -1e300
    elif kind == "dominant":
        x[:3000] = 0.25
    elif kind == "two":
        x = rng.integers(0, 2, 4000).astype(float)
    else:
        x = rng.integers(0, 300, 4000).astype(float)
    frame = pd.DataFrame({"x": x, "y": -x})
    probs = {"a": 0.0, "b": 0.25, "c": 0.4999, "d": 0.75, "e": 1.0}
    got = {r["column"]: r for r in order_stats.exact_quantiles(
        spark.createDataFrame(frame), ["x", "y"], probs, at_once=10).collect()}
    for c in frame:
        for name, p in probs.items():
            assert got[c][name] == pytest.approx(frame[c].quantile(p), abs=1e-12)


def test_quantiles_where_the_sketch_is_coarse(spark):
    frame = pd.DataFrame({"x": np.random.default_rng(5).normal(size=5000)})
    found = order_stats.quantiles_of(
        spark.createDataFrame(frame), {"x": (5000, frame.x.min(), frame.x.max())}, {"q": 0.6}, accuracy=7, at_once=50)
    assert found["x"]["q"] == pytest.approx(frame.x.quantile(0.6), abs=1e-12)


def test_describe_matches_pandas(spark):
    frame = pd.DataFrame({"x": [1.0, 2.0, 3.0, 10.0, None], "k": [5.0] * 5, "none": [None] * 5})
    frame["none"] = frame["none"].astype(float)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(),
                               "x double, k double, none double")
    got = {r["column"]: r for r in explore.describe_numeric(df).collect()}
    want = frame.describe()
    for c in ("x", "k"):
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert got[c][ours] == pytest.approx(want[c][theirs])
    assert got["none"]["count"] == 0 and got["none"]["mean"] is None


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({
        "x": np.r_[rng.normal(size=800), np.arange(0, 1.01, 0.01)], "y": 4.0,
        "c": rng.integers(0, 2, 901)})
    got = explore.histogram(spark.createDataFrame(frame), ["x", "y"], by="c").toPandas()
    for klass in (0, 1):
        for c in ("x", "y"):
            counts, edges = np.histogram(frame.loc[frame.c == klass, c], bins=20)
            part = got[(got["column"] == c) & (got["class"] == str(klass))].sort_values("bin")
            assert part["n"].tolist() == counts.tolist()
            assert np.allclose(part["bin_low"], edges[:-1])
    fixed = explore.histogram(spark.createDataFrame(frame), ["x"], low=0.0, high=1.0).toPandas()
    inside = frame.x[(frame.x >= 0) & (frame.x <= 1)]
    fixed = fixed.set_index("bin")["n"].sort_index()
    assert fixed.loc[0:19].tolist() == np.histogram(inside, bins=20, range=(0, 1))[0].tolist()
    assert (fixed[-1], fixed[20]) == ((frame.x < 0).sum(), (frame.x > 1).sum())


def test_correlation_with_nulls_uses_known_pairs(spark):
    frame = pd.DataFrame(np.random.default_rng(4).normal(size=(200, 3)), columns=list("abc"))
    frame["b"] += frame["a"]
    frame.loc[::7, "c"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(),
                               "a double, b double, c double")
    want = frame.corr()
    for r in explore.correlation_pairs(df).collect():
        assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]])


def test_crosstab_options_and_median(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 2.0), ("b", 1, 9.0), (None, 0, 3.0)],
                               "k string, ChurnRisk int, v double")
    shares = {r["k"]: (r["will_return"], r["will_churn"]) for r in explore.crosstab(df, "k").collect()}
    assert shares == {"a": (0.5, 0.5), "b": (0.0, 1.0)}
    assert [r["value"] for r in explore.distinct_options(df, ["k"]).collect()] == ["a", "b"]
    flagged = {r["v"]: r["above_median"] for r in explore.above_median(df, "v").collect()}
    assert flagged == {1.0: False, 2.0: False, 3.0: True, 9.0: True}
    names = spark.createDataFrame([("TotalSpent",), ("Other",)], "feature string")
    shown = {r["feature"]: r["display_name"]
             for r in explore.feature_display_names(names).collect()}
    assert shown == {"TotalSpent": "Total Spent", "Other": "Other"}


def test_histogram_counts_every_class(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (2, 4.0), (None, 5.0)], "c int, x double")
    totals = explore.histogram(df, ["x"], by="c").groupBy("class").sum("n").collect()
    assert {r["class"]: r["sum(n)"] for r in totals} == {"0": 1, "1": 1, "2": 2}
    named = explore.histogram(df, ["x"], by="c", classes=(1, 2), low=0.0, high=10.0)
    assert {r["class"] for r in named.collect()} == {"1", "2"}
