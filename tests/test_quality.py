import pytest
from pyspark.sql import functions as F

from stayline import functions as fn
from stayline.catalogue import DEFAULT_OF, INPUT_NAMES
from stayline.operators import quality


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_absent_columns_take_their_defaults(spark):
    df, filled = quality.fill_missing_columns(frame(spark, [(1, 50)], "CustomerID long, Age int"))
    row = df.first().asDict()
    assert filled == [n for n in INPUT_NAMES if n != "Age"]
    assert row["Age"] == 50
    assert all(row[n] == DEFAULT_OF[n] for n in filled)


def test_present_nulls_are_not_filled_by_column_filling(spark):
    df, filled = quality.fill_missing_columns(frame(spark, [(None,)], "Age int"))
    assert "Age" not in filled and df.first()["Age"] is None


def test_null_policies(spark):
    df = frame(spark, [(1, None)], "CustomerID long, Age int")
    assert quality.apply_null_policy(df, "keep").first()["Age"] is None
    assert quality.apply_null_policy(df, "default").first()["Age"] == 38
    with pytest.raises(Exception, match="null value in Age"):
        quality.apply_null_policy(df, "fail").collect()
    with pytest.raises(ValueError):
        quality.apply_null_policy(df, "drop")


def test_unknown_categories(spark):
    df = frame(spark, [("Low",), ("Daily",), (None,)], "AppUsage string")
    words = {"AppUsage": ["High", "Low", "Medium"]}
    first = [r[0] for r in quality.sanitize_categories(df, words, "first").collect()]
    default = [r[0] for r in quality.sanitize_categories(df, words, "default").collect()]
    assert first == ["Low", "High", "High"]
    assert default == ["Low", "Medium", "Medium"]
    # A configured default that is no label itself falls back to the first label.
    place = quality.sanitize_categories(
        frame(spark, [("X",)], "Location string"), {"Location": ["FRANCE", "PERU"]}, "default")
    assert place.first()[0] == "FRANCE"


def test_a_label_given_twice_counts_once(spark):
    df = frame(spark, [("a",), ("z",)], "Gender string")
    table = frame(spark, [("Gender", "a"), ("Gender", "a"), ("Gender", "b")], "column string, label string")
    rows = quality.sanitize_categories(df, table).collect()
    assert sorted(r[0] for r in rows) == ["a", "a"]


@pytest.mark.parametrize("most", [0, quality.BROADCAST_BYTES])
def test_a_table_of_many_labels(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_BYTES", most)
    seen = spark.range(20_000).select(F.format_string("city %05d", "id").alias("Location"))
    words = quality.label_table(seen.unionAll(seen), ["Location"])
    df = spark.range(19_990, 20_010).select(
        "id", F.when(F.col("id") % 5 > 0, F.format_string("city %05d", "id")).alias("Location"))
    got = {r["id"]: r["Location"] for r in quality.sanitize_categories(df, words).collect()}
    assert got == {i: f"city {i:05d}" if i % 5 and i < 20_000 else "city 00000" for i in range(19_990, 20_010)}
    usage = quality.label_table(frame(spark, [("High",), ("Medium",)], "AppUsage string"), ["AppUsage"])
    odd = frame(spark, [(None,)], "AppUsage string")
    assert [quality.sanitize_categories(odd, usage, m).first()[0] for m in ("first", "default")] == ["High", "Medium"]


def test_schema_report_and_completeness(spark):
    df = frame(spark, [(1, 5, None, 0.5), (2, None, None, 0.5)],
               "CustomerID long, Age int, Location string, Shoe double")
    report = {r["column"]: (r["status"], r["non_null"])
              for r in quality.schema_report(df).collect()}
    assert report["Age"] == ("present", 1)
    assert report["Location"] == ("present", 0)
    assert report["Gender"] == ("missing", 0)
    assert report["Shoe"] == ("extra", 2)
    assert "CustomerID" not in report
    one = quality.completeness(df).first()
    assert (one["customers"], one["provided"], one["completeness"], one["band"]) == (2, 2, 11, "low")
    full = quality.completeness(quality.fill_missing_columns(df)[0]).first()
    assert full["is_full"] and full["band"] == "high" and full["missing"] == ""


def test_null_counts_and_profile(spark):
    df = frame(spark, [(1, None), (2, "a")], "n int, s string")
    assert {tuple(r) for r in quality.null_counts(df).collect()} == {("n", 0, 2), ("s", 1, 1)}
    profile = {tuple(r) for r in quality.table_profile(df).collect()}
    assert profile == {(1, "n", "int", 2, 2), (2, "s", "string", 2, 1)}
    assert quality.numeric_columns(df) == ["n"]
    assert quality.column_catalogue(df).count() == len(INPUT_NAMES)


def test_bands_status_and_rounding(spark):
    df = frame(spark, [(0.349,), (0.35,), (0.649,), (0.65,), (None,)], "p double")
    bands = [r[0] for r in df.select(fn.risk_band(F.col("p"))).collect()]
    assert bands == ["Low", "Medium", "Medium", "High", None]
    status = frame(spark, [(0,), (1,), (None,)], "p int").select(fn.churn_status(F.col("p")))
    assert [r[0] for r in status.collect()] == ["Will Return", "Will Churn", "Unknown"]
    halves = frame(spark, [(0.125,), (0.375,), (2.5,)], "p double")
    assert [r[0] for r in halves.select(fn.round_even(F.col("p"), 2)).collect()] == [0.12, 0.38, 2.5]
    assert [r[0] for r in halves.select(fn.round_even(F.col("p"))).collect()] == [0.0, 0.0, 2.0]


def test_display_texts(spark):
    df = frame(spark, [(1234567.5, 4), (None, None)], "v double, s int")
    shown = df.select(
        fn.money(F.col("v")), fn.lakh(F.col("v")), fn.rupee_thousands(F.col("v")),
        fn.percent_text(F.col("v")), fn.signed_percent_text(-F.col("v")), fn.stars(F.col("s"), 5))
    assert list(shown.collect()[0]) == [
        "₹1,234,568", "₹12.3L", "₹1235K", "1234567.5%", "-1234567.5%", "★★★★☆"]
    assert list(shown.collect()[1])[:5] == ["N/A"] * 5
