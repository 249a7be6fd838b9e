import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayline.operators import evaluate

SCHEMA = "ChurnRisk int, ChurnPred int, ChurnProb double"


def pairwise_auc(labels, scores):
    pairs = [(p, n) for p, a in zip(scores, labels) if a for n, b in zip(scores, labels) if not b]
    return sum((p > n) + 0.5 * (p == n) for p, n in pairs) / len(pairs) if pairs else None


rows = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1), st.integers(0, 6)),
                min_size=1, max_size=40)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows)
def test_metrics_and_auc_match_their_definitions(spark, many_ranges, rows):
    rows = [(y, p, s / 6) for y, p, s in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    tp = sum(y and p for y, p, _ in rows)
    fp = sum((not y) and p for y, p, _ in rows)
    fn = sum(y and (not p) for y, p, _ in rows)
    m = evaluate.classification_metrics(df).first()
    assert m["accuracy"] == pytest.approx(sum(y == p for y, p, _ in rows) / len(rows))
    assert m["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0)
    assert m["recall"] == pytest.approx(tp / (tp + fn) if tp + fn else 0)
    auc = evaluate.roc_auc(df).first()["auc"]
    expected = pairwise_auc([r[0] for r in rows], [r[2] for r in rows])
    assert (auc is None) if expected is None else auc == pytest.approx(expected)


def test_roc_curve_over_many_ranges(spark, many_ranges):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"ChurnRisk": rng.integers(0, 2, 3000), "ChurnProb": rng.random(3000)})
    frame.loc[frame.index % 3 == 0, "ChurnProb"] = 0.25
    points = evaluate.roc_curve(spark.createDataFrame(frame)).toPandas()
    points = points.sort_values("threshold", ascending=False).reset_index(drop=True)
    assert math.isinf(points.threshold[0]) and points.tp[0] == points.fp[0] == 0
    assert len(points) == frame.ChurnProb.nunique() + 1
    for t in (0.9, 0.25, 0.1):
        row = points[points.threshold >= t].iloc[-1]
        reached = frame[frame.ChurnProb >= row.threshold]
        assert (row.tp, row.fp) == ((reached.ChurnRisk == 1).sum(), (reached.ChurnRisk == 0).sum())
    area = np.trapezoid(points.tpr, points.fpr)
    assert evaluate.roc_auc(spark.createDataFrame(frame)).first()["auc"] == pytest.approx(area)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.4)], SCHEMA)
    assert evaluate.roc_auc(df).first()["auc"] is None
    assert evaluate.roc_curve(df).filter("fpr IS NOT NULL").count() == 0


def test_auc_by_group(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.1), ("b", 0, 0.9)],
                               "m string, ChurnRisk int, ChurnProb double")
    auc = {r["m"]: r["auc"] for r in evaluate.roc_auc(df, by=["m"]).collect()}
    assert auc == {"a": 1.0, "b": 0.0}


def test_confusion_matrix_has_four_cells_and_report_adds_up(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (0, 0, 0.1)], SCHEMA)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 1}
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert report["Will Return"]["recall"] == 0.5 and report["Will Churn"]["precision"] == 0.5
    assert report["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert report["weighted avg"]["recall"] == pytest.approx(2 / 3)
    assert report["macro avg"]["recall"] == pytest.approx(0.75)


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert evaluate.classification_metrics(df).first()["f1"] == 0.0
    assert [r["n"] for r in evaluate.confusion_matrix(df).collect()] == [0, 0, 0, 0]


def test_regression_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "CLV double, PredCLV double")
    row = evaluate.regression_metrics(df).first()
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["mae"] == pytest.approx(np.abs(y - p).mean())


def test_groups_are_evaluated_apart_null_group_included(spark):
    rows = [("a", 1, 1, 0.9), ("a", 0, 1, 0.8), ("a", 1, 0, 0.3), ("b", 1, 1, 0.7), (None, 0, 0, 0.2)]
    df = spark.createDataFrame(rows, "g string, ChurnRisk int, ChurnPred int, ChurnProb double")
    cells = {(r["g"], r["actual"], r["predicted"]): r["n"]
             for r in evaluate.confusion_matrix(df, by=["g"]).collect()}
    assert len(cells) == 12 and cells["a", 1, 0] == 1 and cells["b", 0, 0] == 0 and cells[None, 0, 0] == 1
    for group in ("a", "b"):
        own = df.filter(F.col("g") == group)
        for alone, together in (
            (evaluate.classification_report(own), evaluate.classification_report(df, by=["g"])),
            (evaluate.roc_curve(own), evaluate.roc_curve(df, by=["g"])),
        ):
            together = together.filter(F.col("g") == group).drop("g")
            assert sorted(map(str, alone.collect())) == sorted(map(str, together.collect()))
    nulls = evaluate.roc_curve(df, by=["g"]).filter("g IS NULL").orderBy("threshold").collect()
    assert [(r["threshold"], r["fp"], r["tpr"], r["fpr"]) for r in nulls] == [
        (0.2, 1, None, 1.0), (float("inf"), 0, None, 0.0)]
