import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stayline.catalogue import CHURN_FEATURES, INPUT_NAMES, SEGMENTS
from stayline.operators.evaluate import regression_metrics, roc_auc
from stayline.plans import scoring, training

CONFIG = training.TrainConfig(rf_trees=10, rf_depth=6, gbt_rounds=8, gbt_depth=4, gbt_rate=0.3,
                              clv_rounds=15, clv_depth=4, clv_rate=0.3, restarts=3)


def planted_frame(n=2000, seed=11):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "CustomerID": np.arange(n), "Gender": rng.choice(["Male", "Female"], n),
        "Age": rng.integers(18, 65, n), "Location": rng.choice(["A", "B", "C"], n),
        "MembershipPeriod": rng.integers(1, 60, n),
        "PreferredCategory": rng.choice(["X", "Y"], n), "VisitFrequency": rng.integers(1, 30, n),
        "AvgSessionTime": rng.uniform(2, 45, n), "PagesViewed": rng.integers(1, 20, n),
        "PurchaseFrequency": rng.uniform(0.5, 15, n), "AvgOrderValue": rng.uniform(300, 8000, n),
        "TotalSpent": rng.uniform(300, 150000, n), "LastPurchaseDaysAgo": rng.integers(1, 181, n),
        "DiscountUsed": rng.integers(0, 2, n), "CustomerSatisfaction": rng.integers(1, 6, n),
        "ReturnCount": rng.integers(0, 12, n), "ComplaintHistory": rng.integers(0, 5, n),
        "AppUsage": rng.choice(["Low", "Medium", "High"], n), "CartAbandonRate": rng.uniform(0, 1, n)})
    # The planted rule: two features decide churn, spend decides the value.
    risk = frame.CartAbandonRate + frame.LastPurchaseDaysAgo / 360
    frame["ChurnRisk"] = (risk > 0.75).astype(int)
    frame["CLV"] = 1.2 * frame.TotalSpent + 2 * frame.AvgOrderValue
    return frame


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(planted_frame()).cache()


@pytest.fixture(scope="module")
def models(planted):
    return training.train(planted, CONFIG)


def test_planted_rule_is_learned(spark, models):
    assert models.metrics["gbt_auc"] > 0.95 and models.metrics["rf_auc"] > 0.9
    assert models.metrics["clv_r2"] > 0.8
    assert models.metrics["train_size"] + models.metrics["test_size"] == 2000
    ranked = training.feature_importance(models.candidates["gbt"], spark).collect()
    assert len(ranked) == len(CHURN_FEATURES)
    assert {r["feature"] for r in ranked[:2]} == {"CartAbandonRate", "LastPurchaseDaysAgo"}
    assert len(training.feature_importance(models.churn_model, spark, 10).collect()) == 10
    assert sorted(models.segments.values()) == sorted(SEGMENTS)


def test_selection_prefers_boosting_on_ties():
    assert training.select_best({"rf": 0.9, "gbt": 0.9}) == "gbt"
    assert training.select_best({"rf": 0.91, "gbt": 0.9}) == "rf"
    assert training.select_best({"rf": None, "gbt": None}) == "gbt"


def test_same_seed_same_model(planted, models):
    rows, _ = training.encoded_rows(planted.repartition(5))
    features = training.churn_features(rows)
    one = training.train_rf(rows, features, CONFIG).stages[-1].featureImportances
    again, _ = training.encoded_rows(planted.repartition(3))
    two = training.train_rf(again, features, CONFIG).stages[-1].featureImportances
    assert np.allclose(one.toArray(), two.toArray())


def test_trained_models_score_uploads_and_scenarios(spark, planted, models):
    upload = planted.select("CustomerID", "CartAbandonRate", "LastPurchaseDaysAgo", "Gender",
                            "TotalSpent", "AvgOrderValue").withColumn("Gender", F.lit("?"))
    scored, filled = scoring.score_bulk(upload, models)
    assert set(filled) == set(INPUT_NAMES) - set(upload.columns)
    assert scored.count() == 2000
    assert scored.filter("Segment IS NULL OR PredCLV IS NULL").count() == 0
    full = scoring.score_dashboard(planted, models)
    assert roc_auc(full).first()["auc"] > 0.95
    assert regression_metrics(full).first()["r2"] > 0.8
    # The label column is untouched by the CLV choice of the segmentation.
    requested = scoring.score_requests(planted, models)
    labels = requested.select("CustomerID", "CLV")
    assert labels.exceptAll(planted.select("CustomerID", "CLV")).count() == 0

    from stayline.operators.scenarios import best_action, sensitivity
    effects = sensitivity(planted.limit(50), models)
    assert effects.count() == 400
    assert best_action(effects).count() == 50


def test_summaries(spark, planted, models):
    assert training.model_summary(models, spark).first()["features"] == 18
    compared = training.model_comparison(models, spark)
    assert compared.filter("selected").count() == 1
    from stayline.operators.features import split
    scored = models.churn(split(planted, stratify="ChurnRisk"))
    parts = {r["part"]: r["n"] for r in training.performance(scored).collect()}
    assert parts["all"] == 2000 and parts["train"] + parts["test"] == 2000


def test_save_load_and_staleness(spark, planted, models, tmp_path, monkeypatch):
    path = str(tmp_path / "models")
    assert training.is_stale(spark, path)
    with pytest.raises(FileNotFoundError):
        training.load_models(spark, path)
    training.save_models(models, path, spark)
    assert not training.is_stale(spark, path)
    loaded = training.load_models(spark, path)
    assert sorted(loaded.vocabulary.collect()) == sorted(models.vocabulary.collect())
    assert loaded.segments == models.segments
    columns = ["CustomerID", "ChurnProb", "PredCLV", "Segment"]
    a = scoring.score_dashboard(planted, models).select(columns)
    b = scoring.score_dashboard(planted, loaded).select(columns)
    assert a.exceptAll(b).count() == 0
    # Current models are loaded, not trained again.
    monkeypatch.setattr(training, "train", lambda *_: pytest.fail("trained again"))
    assert training.train_if_stale(planted, path).best == models.best
    monkeypatch.setattr(training, "CLV_FEATURES", ("Age",))
    assert training.is_stale(spark, path)


def test_kmeans_fits_keep_their_own_points(spark, monkeypatch):
    """On a persisted table each of the many passes of a fit would decode all rows again."""
    levels = []

    def fit(vectors, k, *rest):
        levels.append(vectors.storageLevel)
        return None, float(k)

    monkeypatch.setattr(training, "train_kmeans", fit)
    df = spark.range(20).select(
        F.col("id").alias("CustomerID"), *[(F.col("id") * 1.0).alias(c) for c in training.RFM_FEATURES])
    curve = training.elbow_curve(df, ks=(2, 5, 3), restarts=1).collect()
    assert [tuple(r) for r in curve] == [(2, 2.0), (5, 5.0), (3, 3.0)]
    assert len(levels) == 3 and not any(level.useMemory or level.useDisk for level in levels)


def test_kmeans_recovers_blobs_and_elbow_falls(spark):
    rng = np.random.default_rng(12)
    centres = np.array([[0, 0, 0, 0, 0], [9, 0, 0, 9, 0], [0, 9, 9, 0, 0], [9, 9, 9, 9, 9]])
    points = np.vstack([c + rng.normal(scale=0.3, size=(100, 5)) for c in centres])
    vectors = spark.createDataFrame(
        [(i, Vectors.dense(p)) for i, p in enumerate(points)], ["CustomerID", "rfm_features"]).cache()
    model, cost = training.train_kmeans(vectors, 4, restarts=3)
    found = [r["Cluster"] for r in model.transform(vectors).orderBy("CustomerID").collect()]
    assert all(len(set(found[i * 100:(i + 1) * 100])) == 1 for i in range(4))
    assert len(set(found)) == 4
    worse, single = training.train_kmeans(vectors, 4, restarts=1)
    assert cost <= single

    names = ["LastPurchaseDaysAgo", "PurchaseFrequency", "TotalSpent", "CustomerSatisfaction", "CLV"]
    df = spark.createDataFrame(pd.DataFrame(points, columns=names).assign(CustomerID=range(400)))
    curve = training.elbow_curve(df, ks=range(2, 6), restarts=2).orderBy("k").collect()
    assert [r["k"] for r in curve] == [2, 3, 4, 5]
    assert all(r["inertia"] >= 0 for r in curve) and curve[0]["inertia"] > curve[2]["inertia"] * 5


def test_boosting_is_refused_on_a_cluster_without_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from stayline.sources import staging

    made = []
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=made.append)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.need_checkpoint_dir(session)
    context.master = "local[4]"
    staging.need_checkpoint_dir(session)
    assert len(made) == 1
