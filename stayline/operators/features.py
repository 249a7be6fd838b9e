"""Label encoding, population scaling, vector assembly, reproducible splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.catalogue import ENCODED, ID
from stayline.operators.order_stats import running_totals
from stayline.operators.quality import Vocabulary, joined_labels, label_table
from stayline.sources.staging import stage


CODES = "column string, label string, code long"


def codes_for(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(column, label, code) of short lists of labels: codes 0..n-1 in the lists' order."""
    rows = [(c, label, code) for c, labels in vocabulary.items() for code, label in enumerate(labels)]
    return spark.createDataFrame(rows, CODES)


def label_codes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, label, code): codes 0..n-1 in alphabetical label order, for any number of labels.

    Null is a label like any other where a column has it (a customer without a nation, or whose lines have no
    part), and the last of its column. A distributed dense rank: distinct labels are ranged by (column, label) and each range starts from
    the sum of those before it. The table is staged; nothing of it is listed on the driver.
    """
    named = [c for c in ENCODED if c in df.columns] if columns is None else list(columns)
    labels = label_table(df, named, nulls=True).withColumns({
        "one": F.lit(1).cast("long"), "place": F.struct(F.col("label").isNull(), "label")})
    ranked = running_totals(labels, "place", ["one"], by=["column"])
    return stage(ranked.select("column", "label", (F.col("cum_one") - 1).alias("code")))


def encode(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Add the code of each encoded column; a label that has none, null included, is an error.

    A column's codes are joined in: sent to every task up to a measured size, by shuffle beyond it.
    """
    for name, known in joined_labels(codes, [c for c in ENCODED if c in df.columns]):
        unknown = F.raise_error(F.concat(F.lit(f"unknown label in {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))
        df = df.join(known.select(F.col("label").alias("_known"), F.col("code").alias("_code")),
                     F.col(name).cast("string").eqNullSafe(F.col("_known")), "left") \
            .withColumn(ENCODED[name], F.coalesce(F.col("_code").cast("double"), unknown.cast("double"))) \
            .drop("_known", "_code")
    return df


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column."""

    mean: Mapping[str, float]
    std: Mapping[str, float]

    def scaled(self, column: str) -> Column:
        std = self.std[column]
        centred = F.col(column) - F.lit(self.mean[column])
        return centred if std == 0 else centred / F.lit(std)

    def stage(self, suffix: str) -> SQLTransformer:
        """The same scaling as a step of a savable pipeline."""
        parts = []
        for column, mean in self.mean.items():
            centred = f"(CAST(`{column}` AS DOUBLE) - CAST('{mean!r}' AS DOUBLE))"
            std = self.std[column]
            scaled = centred if std == 0 else f"{centred} / CAST('{std!r}' AS DOUBLE)"
            parts.append(f"{scaled} AS `{column}{suffix}`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    return Scaler({c: float(row[f"m_{i}"] or 0.0) for i, c in enumerate(columns)},
                  {c: float(row[f"s_{i}"] or 0.0) for i, c in enumerate(columns)})


def scale(df: DataFrame, scaler: Scaler, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[scaler.scaled(c).alias(c) for c in scaler.mean])


def assembler(columns: Sequence[str], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error")


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return assembler(columns, out).transform(df)


def feature_pipeline(scaler: Scaler, suffix: str, out: str) -> PipelineModel:
    """Scale and assemble, as one fitted pipeline."""
    return PipelineModel([scaler.stage(suffix), assembler([c + suffix for c in scaler.mean], out)])


# Order of the rows for a split: the hex MD5 of "id|seed", uniform, independent of
# partitioning and the same in any engine. Buckets are its first digits, ranks are
# settled inside one bucket.
_BUCKET_DIGITS = 4


def _hash(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def _bucket(hashed: Column) -> Column:
    return F.substring(hashed, 1, _BUCKET_DIGITS)


def _cut_hashes(df: DataFrame, fraction: float, classes: Sequence[object]) -> dict:
    """Per class, the hash up to which the class's share of training rows lies.

    First the bucket holding the cut is found from counts (2^16 buckets per
    class); then only the rows of that bucket are ranked.
    """
    sizes = df.groupBy("_class", _bucket(F.col("_hash")).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    per_class = W.partitionBy("_class")
    run = per_class.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    # Train size as in a split whose test side is rounded up.
    target = F.col("total") - F.ceil(F.col("total") * F.lit(1.0 - fraction) - F.lit(1e-9))
    cut = sizes.withColumns({
        "total": F.sum("n").over(per_class), "upto": F.sum("n").over(run),
    }).withColumn("target", target).filter(
        (F.col("upto") >= F.col("target")) & (F.col("upto") - F.col("n") < F.col("target"))
    ).select("_class", "_bucket", (F.col("target") - F.col("upto") + F.col("n")).alias("rank"))
    cuts = {r["_class"]: (r["_bucket"], r["rank"]) for r in cut.collect()}

    at_cut = F.lit(False)
    for klass, (bucket, _) in cuts.items():
        at_cut = at_cut | ((F.col("_class") == klass) & (_bucket(F.col("_hash")) == bucket))
    # Equal hashes are counted together, so repeated ids stay one row here.
    upto = F.sum("n").over(per_class.orderBy("_hash").rowsBetween(
        W.unboundedPreceding, W.currentRow))
    ranked = df.filter(at_cut).groupBy("_class", "_hash").agg(
        F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    reached = F.lit(False)
    for klass, (_, rank) in cuts.items():
        reached = reached | ((F.col("_class") == klass) & (F.col("upto") >= rank))
    found = {r["_class"]: r["limit"] for r in ranked.filter(reached).groupBy("_class").agg(
        F.min("_hash").alias("limit")).collect()}
    return {k: found[k] for k in map(int, classes) if k in found}


def split(
    df: DataFrame, fraction: float = 0.8, seed: int = 42, stratify: str | None = None,
    classes: Sequence[int] = (0, 1), key: str = ID,
) -> DataFrame:
    """Add `is_train`: a repeatable split that does not depend on partitioning.

    Plain: the hash of the id decides row by row. Stratified: each of `classes`
    gives its exact share, found with two bounded passes over (class, hash);
    rows of no listed class go to the test side.
    """
    if stratify is None:
        if fraction >= 1:
            return df.withColumn("is_train", F.lit(True))
        limit = f"{int(max(0.0, fraction) * (1 << 32)):08x}"
        return df.withColumn("is_train", F.substring(_hash(seed, key), 1, 8) < F.lit(limit))
    hashed = df.filter(F.col(stratify).isin(list(classes))).select(
        F.col(stratify).cast("int").alias("_class"), _hash(seed, key).alias("_hash"))
    train = F.lit(False)
    for klass, limit in _cut_hashes(hashed, fraction, classes).items():
        train = train | ((F.col(stratify) == klass) & (_hash(seed, key) <= F.lit(limit)))
    return df.withColumn("is_train", F.coalesce(train, F.lit(False)))


def split_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label, "is_train").agg(F.count(F.lit(1)).alias("n"))
