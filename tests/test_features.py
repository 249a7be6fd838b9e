import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stayline.operators import features, quality

LABELS = {"Gender": ["Female", "Male"], "AppUsage": ["High", "Low", "Medium"]}


def test_codes_follow_the_alphabet(spark):
    df = spark.createDataFrame([("Male", "Low"), ("Female", "Medium")], "Gender string, AppUsage string")
    codes = features.codes_for(spark, LABELS)
    rows = features.encode(df, codes).select("Gender_enc", "AppUsage_enc").collect()
    assert sorted(tuple(r) for r in rows) == [(0.0, 2.0), (1.0, 1.0)]
    assert [tuple(r) for r in codes.collect()][:2] == [("Gender", "Female", 0), ("Gender", "Male", 1)]
    for label in (F.lit("U"), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="unknown label in Gender"):
            features.encode(df.withColumn("Gender", label), codes).collect()
    learned = features.label_codes(df).orderBy("column", "code").collect()
    assert [tuple(r) for r in learned] == [
        ("AppUsage", "Low", 0), ("AppUsage", "Medium", 1), ("Gender", "Female", 0), ("Gender", "Male", 1)]


@pytest.mark.parametrize("most", [0, quality.BROADCAST_BYTES])
def test_a_null_label_is_the_last_of_its_column(spark, monkeypatch, many_ranges, most):
    """As dense_rank with nulls last: a customer without a nation, or whose lines have no part, has a code too."""
    monkeypatch.setattr(quality, "BROADCAST_BYTES", most)
    rows = [("PERU", "LARGE", "Low"), (None, None, "High"), ("CHINA", None, "Low"), (None, None, "Low")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "CustomerID long, Location string, PreferredCategory string, AppUsage string")
    codes = features.label_codes(df)
    got = features.encode(df, codes).orderBy("CustomerID").select("Location_enc", "Category_enc", "AppUsage_enc")
    assert [tuple(r) for r in got.collect()] == [(1, 0, 1), (2, 1, 0), (0, 1, 1), (2, 1, 1)]
    # Nulls of a later upload get the column's default or first label, as before.
    clean = quality.sanitize_categories(df, codes, "first").orderBy("CustomerID")
    assert [tuple(r) for r in clean.select("Location", "PreferredCategory").collect()] == [
        ("PERU", "LARGE"), ("CHINA", "LARGE"), ("CHINA", "LARGE"), ("CHINA", "LARGE")]
    void = df.withColumn("Location", F.lit(None).cast("string"))
    assert {r["Location_enc"] for r in features.encode(void, features.label_codes(void)).collect()} == {0.0}


@pytest.mark.parametrize("most", [0, quality.BROADCAST_BYTES])
def test_a_million_labels_are_encoded(spark, monkeypatch, many_ranges, most):
    """No list of labels on the driver: codes are ranks of a table, joined in by shuffle where it is large."""
    monkeypatch.setattr(quality, "BROADCAST_BYTES", most)
    n = 1_000_000
    df = spark.range(2 * n).select(
        F.format_string("c%07d", (F.col("id") * 7919) % n).alias("Location"), F.lit("Male").alias("Gender"), "id")
    codes = features.label_codes(df)
    got = features.encode(df, codes)
    wrong = got.filter((F.col("Location_enc") != F.substring("Location", 2, 7).cast("double")) | (F.col("Gender_enc") != 0))
    assert codes.count() == n + 1 and got.count() == 2 * n and wrong.isEmpty()


def test_population_scaling_and_constant_columns(spark):
    frame = pd.DataFrame({"x": [1.0, 2.0, 6.0], "k": [3, 3, 3]})
    df = spark.createDataFrame(frame)
    scaler = features.fit_scaler(df, ["x", "k"])
    got = features.scale(df, scaler).toPandas()
    assert np.allclose(got["x"], (frame.x - frame.x.mean()) / frame.x.std(ddof=0))
    assert (got["k"] == 0).all()
    # The pipeline step gives the same numbers as the expressions.
    vectors = features.feature_pipeline(scaler, "_z", "v").transform(df).select("v").collect()
    assert np.allclose([r["v"].toArray() for r in vectors], got[["x", "k"]].to_numpy())


def test_scaling_step_survives_saving(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (4.0,)], "x double")
    model = features.feature_pipeline(features.fit_scaler(df, ["x"]), "_z", "v")
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df)
    assert [r["v"][0] for r in again.collect()] == [-1.0, 1.0]


def labelled(spark, n=1000):
    return spark.range(n).select(
        F.col("id").alias("CustomerID"), (F.col("id") % 3 == 0).cast("int").alias("ChurnRisk"))


def test_stratified_split_is_exact_disjoint_and_repeatable(spark):
    df = labelled(spark)
    parts = features.split(df, stratify="ChurnRisk")
    for r in features.split_sizes(parts, "ChurnRisk").collect():
        size = 334 if r["ChurnRisk"] else 666
        test = math.ceil(size * 0.2)
        assert r["n"] == (size - test if r["is_train"] else test)
    again = features.split(df.repartition(3).orderBy(F.desc("CustomerID")), stratify="ChurnRisk")
    assert parts.count() == 1000
    assert parts.exceptAll(again).count() == 0
    other = features.split(df, stratify="ChurnRisk", seed=7)
    assert parts.exceptAll(other).count() > 0


def test_plain_split(spark):
    parts = features.split(labelled(spark, 5000))
    share = parts.filter("is_train").count() / 5000
    assert abs(share - 0.8) < 0.03
    assert parts.exceptAll(features.split(labelled(spark, 5000).repartition(7))).count() == 0


def test_split_with_a_missing_class(spark):
    df = labelled(spark, 100).withColumn("ChurnRisk", F.lit(1))
    assert features.split(df, stratify="ChurnRisk").filter("is_train").count() == 80
    unknown = df.withColumn("ChurnRisk", F.lit(None).cast("int"))
    assert features.split(unknown, stratify="ChurnRisk").filter("is_train").count() == 0
