"""Fitting, selecting, saving and reloading the churn, CLV and segment models.

Every fit is a Spark ML job over one staged, deterministically laid out input;
only model summaries and a few rows return to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

import pyspark
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.catalogue import (
    CHURN_FEATURES, CHURN_LABEL, CLV_FEATURES, CLV_LABEL, ID, INPUT_NAMES, RFM_FEATURES,
)
from stayline.functions import churn_class
from stayline.operators.evaluate import classification_metrics, regression_metrics, roc_auc
from stayline.operators.features import (
    CODES, Scaler, encode, feature_pipeline, fit_scaler, label_codes, split,
)
from stayline.operators.segments import cluster_profile, segment_map, with_segment
from stayline.sources.staging import need_checkpoint_dir, stage


@dataclass(frozen=True)
class TrainConfig:
    """Model sizes. `smoke` is for quick runs; the defaults are the full sizes."""

    rf_trees: int = 200
    rf_depth: int = 10
    rf_min_leaf: int = 3
    gbt_rounds: int = 200
    gbt_depth: int = 6
    gbt_rate: float = 0.05
    gbt_rows: float = 0.8
    gbt_columns: float = 0.8
    clv_rounds: int = 200
    clv_depth: int = 5
    clv_rate: float = 0.05
    clusters: int = 4
    restarts: int = 10
    max_bins: int = 256
    fraction: float = 0.8
    seed: int = 42
    parallelism: int = 4

    @staticmethod
    def smoke() -> TrainConfig:
        return TrainConfig(rf_trees=8, rf_depth=4, gbt_rounds=5, gbt_depth=3, gbt_rate=0.3,
                           clv_rounds=5, clv_depth=3, clv_rate=0.3, restarts=2)


MIN_PARTS = 8


def laid_out(df: DataFrame, rows_per_part: int = 250_000, staged: bool = False) -> DataFrame:
    """The training table, staged in a layout that depends on its rows only.

    Tree growing samples per partition, so equal data must land in equal
    partitions for equal seeds to give equal models, on any cluster: the number
    of partitions follows from the number of rows. The table is derived once; the
    count, the layout and the many passes of the fits read what was staged. `staged` says that
    `df` comes from a staged table row by row, so that it isn't staged again.
    """
    derived = df if staged else stage(df)
    parts = max(MIN_PARTS, -(-derived.count() // rows_per_part))
    return stage(derived.repartition(parts, ID).sortWithinPartitions(ID))


def encoded_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training table with the codes of its labels, laid out; and the table of the codes."""
    derived = stage(df)
    codes = label_codes(derived)
    return laid_out(encode(derived, codes), staged=True), codes


def predict_churn(model: PipelineModel, df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Add ChurnProb and ChurnPred; `codes` encodes rows that aren't encoded yet."""
    kept = list(dict.fromkeys(c for c in df.columns if c not in ("ChurnProb", "ChurnPred")))
    rows = df if codes is None else encode(df, codes)
    prob = vector_to_array("probability")[1]
    return model.transform(rows).select(*kept, prob.alias("ChurnProb")).withColumn(
        "ChurnPred", churn_class(F.col("ChurnProb")))


def churn_features(encoded: DataFrame) -> PipelineModel:
    return feature_pipeline(fit_scaler(encoded, CHURN_FEATURES), "_z", "churn_features")


def _fit(features: PipelineModel, learner, train_rows: DataFrame) -> PipelineModel:
    model = learner.fit(features.transform(train_rows))
    return PipelineModel(list(features.stages) + [model])


def train_rf(train_rows: DataFrame, features: PipelineModel, config: TrainConfig) -> PipelineModel:
    return _fit(features, RandomForestClassifier(
        featuresCol="churn_features", labelCol=CHURN_LABEL, numTrees=config.rf_trees,
        maxDepth=config.rf_depth, minInstancesPerNode=config.rf_min_leaf,
        featureSubsetStrategy="sqrt", maxBins=config.max_bins, seed=config.seed), train_rows)


def train_gbt(train_rows: DataFrame, features: PipelineModel, config: TrainConfig) -> PipelineModel:
    need_checkpoint_dir(train_rows.sparkSession)
    return _fit(features, GBTClassifier(
        featuresCol="churn_features", labelCol=CHURN_LABEL, maxIter=config.gbt_rounds,
        maxDepth=config.gbt_depth, stepSize=config.gbt_rate,
        subsamplingRate=config.gbt_rows, featureSubsetStrategy=str(config.gbt_columns),
        checkpointInterval=10, maxBins=config.max_bins, seed=config.seed), train_rows)


def train_clv(train_rows: DataFrame, scaler: Scaler, config: TrainConfig) -> PipelineModel:
    need_checkpoint_dir(train_rows.sparkSession)
    features = feature_pipeline(scaler, "_v", "clv_features")
    return _fit(features, GBTRegressor(
        featuresCol="clv_features", labelCol=CLV_LABEL, maxIter=config.clv_rounds,
        maxDepth=config.clv_depth, stepSize=config.clv_rate, checkpointInterval=10,
        maxBins=config.max_bins, seed=config.seed), train_rows)


def rfm_features(scaler: Scaler) -> PipelineModel:
    return feature_pipeline(scaler, "_s", "rfm_features")


def rfm_vectors(df: DataFrame, scaler: Scaler) -> DataFrame:
    return rfm_features(scaler).transform(df).select(ID, "rfm_features")


def side_by_side(
    spark: SparkSession, jobs: Mapping[str, Callable[[], object]], parallelism: int
) -> dict[str, object]:
    """Run independent fits from a few driver threads, so their Spark jobs overlap.

    A tree ensemble is a long chain of short jobs; one chain alone leaves a cluster
    mostly idle.
    """
    with ThreadPoolExecutor(max(1, min(parallelism, len(jobs)))) as pool:
        carry = inheritable_thread_target(spark)
        running = {n: pool.submit(carry(job)) for n, job in jobs.items()}
        return {n: future.result() for n, future in running.items()}


def train_kmeans(
    vectors: DataFrame, k: int = 4, restarts: int = 10, seed: int = 42, parallelism: int = 4
):
    """The cheapest of several seeded k-means fits, and its cost; the lower seed wins ties.

    `vectors` should follow from staged rows and not be persisted: then a fit keeps its points as objects
    for its many passes, while every pass over a persisted table decodes all its rows again.
    """
    def fit(s: int):
        model = KMeans(k=k, seed=s, maxIter=300, solver="row", featuresCol="rfm_features",
                       predictionCol="Cluster").fit(vectors)
        return model, model.summary.trainingCost

    seeds = {str(s): partial(fit, s) for s in range(seed, seed + restarts)}
    fits = side_by_side(vectors.sparkSession, seeds, parallelism)
    return min(fits.values(), key=lambda f: f[1])


def elbow_curve(
    df: DataFrame, ks: Sequence[int] = range(2, 9), restarts: int = 10, seed: int = 42
) -> DataFrame:
    """(k, inertia) of the best fit per k over the scaled RFM vectors."""
    rows = laid_out(df.select(ID, *RFM_FEATURES))
    vectors = rfm_vectors(rows, fit_scaler(rows, RFM_FEATURES))
    fits = side_by_side(df.sparkSession, {  # the longest first
        str(k): partial(train_kmeans, vectors, k, restarts, seed, 1) for k in sorted(ks, reverse=True)}, 4)
    costs = [(k, float(fits[str(k)][1])) for k in ks]
    return df.sparkSession.createDataFrame(costs, "k long, inertia double")


def feature_importance(
    model: PipelineModel, spark: SparkSession, n: int | None = None
) -> DataFrame:
    """(feature, importance) of a fitted churn model, most important first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(CHURN_FEATURES, map(float, weights)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows[:n], "feature string, importance double")


def select_best(aucs: Mapping[str, float | None]) -> str:
    """The candidate of highest test AUC; boosting wins ties."""
    order = ("gbt", "rf")
    return max((n for n in order if n in aucs),
               key=lambda n: (-1.0 if aucs[n] is None else aucs[n], -order.index(n)))


@dataclass(frozen=True)
class Models:
    """Fitted models as a scorer."""

    churn_model: PipelineModel
    clv_model: PipelineModel
    rfm_model: PipelineModel
    segments: Mapping[int, str]
    vocabulary: DataFrame  # (column, label, code) of any number of labels
    best: str = "gbt"
    metrics: Mapping[str, object] = field(default_factory=dict)
    candidates: Mapping[str, PipelineModel] = field(default_factory=dict)
    inputs: tuple[str, ...] = INPUT_NAMES

    def churn(self, df: DataFrame) -> DataFrame:
        return predict_churn(self.churn_model, df, self.vocabulary)

    def clv(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != "PredCLV"]
        return self.clv_model.transform(df).select(*kept, F.col("prediction").alias("PredCLV"))

    def segment(self, df: DataFrame, clv: str) -> DataFrame:
        kept = [c for c in df.columns if c not in ("Cluster", "Segment")]
        # The model reads the CLV column by name, whichever source it comes from.
        source = df.withColumn("_clv_label", F.col(CLV_LABEL) if CLV_LABEL in df.columns
                               else F.lit(None).cast("double")).withColumn(CLV_LABEL, F.col(clv))
        found = self.rfm_model.transform(source)
        back = [F.col("_clv_label").alias(c) if c == CLV_LABEL else F.col(c) for c in kept]
        return with_segment(found.select(*back, "Cluster"), self.segments)


def train(df: DataFrame, config: TrainConfig | None = None) -> Models:
    """Fit all models on a complete, labelled customer table."""
    config = config or TrainConfig()
    rows, vocabulary = encoded_rows(df.select(ID, *INPUT_NAMES, CHURN_LABEL, CLV_LABEL))
    features = churn_features(rows)
    parts = split(rows, config.fraction, config.seed, stratify=CHURN_LABEL)
    fit_rows, test = parts.filter("is_train"), parts.filter("not is_train")
    clv_parts = split(rows, config.fraction, config.seed)
    clv_scaler = fit_scaler(rows, CLV_FEATURES)
    rfm = rfm_features(fit_scaler(rows, RFM_FEATURES))
    vectors = rfm.transform(rows)
    fits = side_by_side(df.sparkSession, {
        "gbt": partial(train_gbt, fit_rows, features, config),
        "clv": partial(train_clv, clv_parts.filter("is_train"), clv_scaler, config),
        "rf": partial(train_rf, fit_rows, features, config),
        "kmeans": partial(train_kmeans, vectors, config.clusters, config.restarts, config.seed),
    }, config.parallelism)
    kmeans, _ = fits["kmeans"]
    profile = cluster_profile(kmeans.transform(vectors))
    segments = {r["Cluster"]: r["Segment"] for r in segment_map(profile).collect()}

    candidates = {name: fits[name] for name in ("rf", "gbt")}
    metrics: dict[str, object] = {}
    for name, model in candidates.items():
        scored = stage(predict_churn(model, test).select(CHURN_LABEL, "ChurnProb", "ChurnPred"))
        metrics[f"{name}_auc"] = roc_auc(scored).first()["auc"]
        metrics[f"{name}_accuracy"] = classification_metrics(scored).first()["accuracy"]
    best = select_best({n: metrics[f"{n}_auc"] for n in candidates})
    clv_model = fits["clv"]
    fitted = regression_metrics(clv_model.transform(clv_parts.filter("not is_train"))
                                .withColumnRenamed("prediction", "PredCLV")).first()
    metrics.update(clv_r2=fitted["r2"], clv_mae=fitted["mae"])

    sizes = {r["is_train"]: r["n"] for r in
             parts.groupBy("is_train").agg(F.count(F.lit(1)).alias("n")).collect()}
    metrics.update(train_size=sizes.get(True, 0), test_size=sizes.get(False, 0))
    return Models(candidates[best], clv_model, PipelineModel(list(rfm.stages) + [kmeans]),
                  segments, vocabulary, best, metrics, candidates)


def model_comparison(models: Models, spark: SparkSession) -> DataFrame:
    """(model, accuracy, auc, selected) on the test rows."""
    rows = [(n, models.metrics[f"{n}_accuracy"], models.metrics[f"{n}_auc"], n == models.best)
            for n in ("rf", "gbt")]
    return spark.createDataFrame(rows, "model string, accuracy double, auc double, selected boolean")


def performance(scored: DataFrame) -> DataFrame:
    """Churn metrics of a split, scored table for its train rows, test rows and all rows.

    Each row is counted for its own part and for `all`, in one aggregation.
    """
    part = F.explode(F.array(F.when(F.col("is_train"), "train").otherwise("test"), F.lit("all")))
    rows = stage(scored.select(CHURN_LABEL, "ChurnProb", "ChurnPred", "is_train")).withColumn(
        "part", part)
    metrics = classification_metrics(rows, by=["part"])
    return metrics.join(roc_auc(rows, by=["part"]).select("part", "auc"), "part")


ALGORITHMS = {"gbt": "Gradient-boosted trees", "rf": "Random forest"}
ARTEFACTS = ("churn", "clv", "rfm", "segments", "metadata")


def model_summary(models: Models, spark: SparkSession) -> DataFrame:
    m = models.metrics
    row = (ALGORITHMS[models.best], m["train_size"], m["test_size"], len(CHURN_FEATURES),
           m[f"{models.best}_accuracy"], m[f"{models.best}_auc"], m["clv_r2"], m["clv_mae"],
           len(models.segments), ", ".join(ARTEFACTS))
    return spark.createDataFrame(
        [row], "algorithm string, train_size long, test_size long, features long, "
               "accuracy double, auc double, clv_r2 double, clv_mae double, "
               "segments long, artefacts string")


#: Of saved models: 2 has the label codes as a table of their own.
FORMAT = 2


def _metadata(models: Models) -> dict[str, object]:
    return {
        "spark_version": pyspark.__version__,
        "churn_features": list(CHURN_FEATURES), "clv_features": list(CLV_FEATURES),
        "rfm_features": list(RFM_FEATURES), "best": models.best,
        "format": FORMAT,
        **{k: v for k, v in models.metrics.items()},
    }


_METADATA_SCHEMA = (
    "spark_version string, churn_features array<string>, clv_features array<string>, "
    "rfm_features array<string>, best string, format int, "
    "rf_auc double, rf_accuracy double, gbt_auc double, gbt_accuracy double, "
    "clv_r2 double, clv_mae double, train_size long, test_size long"
)


def save_models(models: Models, path: str, spark: SparkSession) -> None:
    """Write the fitted pipelines, the label codes, the segment names and, last, the metadata."""
    for name, model in (("churn", models.churn_model), ("clv", models.clv_model),
                        ("rfm", models.rfm_model)):
        model.write().overwrite().save(f"{path}/{name}")
    models.vocabulary.write.mode("overwrite").parquet(f"{path}/labels")
    spark.createDataFrame(list(models.segments.items()), "Cluster int, Segment string").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/segments")
    spark.createDataFrame([_metadata(models)], _METADATA_SCHEMA).coalesce(1).write.mode(
        "overwrite").json(f"{path}/metadata")


def _read_metadata(spark: SparkSession, path: str):
    try:
        return spark.read.schema(_METADATA_SCHEMA).json(f"{path}/metadata").first()
    except pyspark.errors.AnalysisException:
        return None


def load_models(spark: SparkSession, path: str) -> Models:
    meta = _read_metadata(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no trained models at {path}")
    segments = {r["Cluster"]: r["Segment"] for r in
                spark.read.parquet(f"{path}/segments").collect()}
    numbers = {k: v for k, v in meta.asDict().items() if isinstance(v, (int, float)) and k != "format"}
    return Models(
        PipelineModel.load(f"{path}/churn"), PipelineModel.load(f"{path}/clv"),
        PipelineModel.load(f"{path}/rfm"), segments,
        spark.read.schema(CODES).parquet(f"{path}/labels"), meta["best"], numbers)


def is_stale(spark: SparkSession, path: str) -> bool:
    """True when nothing is saved, or it was made by another version, format or feature list."""
    meta = _read_metadata(spark, path)
    return meta is None or (
        meta["format"], meta["spark_version"], meta["churn_features"], meta["clv_features"], meta["rfm_features"]
    ) != (FORMAT, pyspark.__version__, list(CHURN_FEATURES), list(CLV_FEATURES), list(RFM_FEATURES))


def train_if_stale(df: DataFrame, path: str, config: TrainConfig | None = None) -> Models:
    spark = df.sparkSession
    if is_stale(spark, path):
        save_models(train(df, config), path, spark)
    return load_models(spark, path)
