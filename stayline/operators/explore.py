"""Exploration: describe, crosstab, correlation, histograms, options."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.catalogue import CHURN_LABEL, FEATURE_NAMES
from stayline.operators.order_stats import exact_quantiles, quantiles_of
from stayline.operators.quality import null_counts, numeric_columns

# Columns whose distributions are compared between the classes.
HISTOGRAM_COLUMNS = (
    "Age", "CustomerSatisfaction", "LastPurchaseDaysAgo", "ComplaintHistory",
    "CartAbandonRate", "TotalSpent",
)
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column; all exact.

    One pass gives everything but the quartiles, which read `df` again.
    """
    columns = list(columns or numeric_columns(df))
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[
        f(F.col(c).cast("double")).alias(f"{name}_{i}")
        for i, c in enumerate(columns) for name, f in parts.items()]).first()
    basic = {c: {name: row[f"{name}_{i}"] for name in parts} for i, c in enumerate(columns)}
    middle = quantiles_of(df, {c: (b["count"], b["min"], b["max"]) for c, b in basic.items()}, QUARTILES)
    names = ("count", "mean", "std", "min", *QUARTILES, "max")
    return df.sparkSession.createDataFrame(
        [(c, *[{**basic[c], **middle[c]}[name] for name in names]) for c in columns],
        "column string, count long, " + ", ".join(f"{name} double" for name in names[1:]))


def crosstab(df: DataFrame, key: str, label: str = CHURN_LABEL) -> DataFrame:
    """Share of label 0 and 1 within each value of `key`."""
    known = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    total = F.count(F.lit(1))
    return known.groupBy(key).agg(
        (F.count_if(F.col(label) == 0) / total).alias("will_return"),
        (F.count_if(F.col(label) == 1) / total).alias("will_churn"))


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) for every pair of numeric columns, label excluded.

    The correlation matrix is one distributed Gram matrix over assembled vectors;
    only the small matrix reaches the driver. A pair with nulls on either side is
    computed over the rows where both are known. `df` is read a few times.
    """
    columns = sorted(columns or numeric_columns(df, exclude=(CHURN_LABEL,)))
    vectors = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="keep").transform(
        df.select([F.col(c).cast("double").alias(c) for c in columns])).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    found = {(a, b): float(matrix[i][j])
             for (i, a), (j, b) in combinations(list(enumerate(columns)), 2)}
    unclear = [pair for pair, r in found.items() if math.isnan(r)]
    if unclear:
        row = df.agg(*[F.corr(a, b).alias(f"r_{i}") for i, (a, b) in enumerate(unclear)]).first()
        found.update({pair: row[f"r_{i}"] for i, pair in enumerate(unclear)})
    return df.sparkSession.createDataFrame(
        [(a, b, r) for (a, b), r in found.items()], "a string, b string, r double")


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin; the last one is closed. A value is moved to its neighbour
    when rounding put it on the wrong side of a bin edge."""
    step = (high - low) / F.lit(float(bins))
    first = F.least(
        F.floor((value - low) / (high - low) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
    return (F.when(value < low + first * step, first - 1)
            .when((first < bins - 1) & (value >= low + (first + 1) * step), first + 1)
            .otherwise(first))


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = 20, by: str | None = None,
    classes: Sequence[object] | None = None, low: float | None = None, high: float | None = None,
) -> DataFrame:
    """(column, class, bin, bin_low, bin_high, n), empty bins included.

    Without fixed bounds each column of each class spans its own min..max, found
    in a first pass over `df`. With `by`, every class of the table is counted, or
    those named; `by` is a label, so the bounds are few. Rows of a null class and null
    values are not counted. Values outside fixed bounds are counted in bin -1 (no lower end)
    or bin `bins` (no upper end); these rows exist only where there are such values.
    """
    class_of = F.col(by) if by else F.lit("all")
    wide = df.select(class_of.cast("string").alias("class"),
                     *[F.col(c).cast("double").alias(c) for c in columns])
    if by and classes is not None:
        wide = wide.filter(F.col("class").isin([str(c) for c in classes]))
    values = wide.filter(F.col("class").isNotNull()).unpivot(
        ["class"], list(columns), "column", "value").filter(F.col("value").isNotNull())
    if low is None or high is None:
        spans = [(r["column"], r["class"], r["lo"], r["hi"]) for r in values.groupBy(
            "column", "class").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()]
    else:
        if by is None:
            names = ["all"]
        elif classes is not None:
            names = [str(c) for c in classes]
        else:
            names = [r["class"] for r in wide.filter(F.col("class").isNotNull()).select("class").distinct().collect()]
        spans = [(c, k, float(low), float(high)) for c in columns for k in names]
    # A constant column gets bins around its value.
    spans = [(c, k, lo - 0.5, hi + 0.5) if lo == hi else (c, k, lo, hi) for c, k, lo, hi in spans]
    bounds = df.sparkSession.createDataFrame(
        spans, "column string, class string, lo double, hi double")
    place = (F.when(F.col("value") < F.col("lo"), F.lit(-1))
             .when(F.col("value") > F.col("hi"), F.lit(bins))
             .otherwise(_bin(F.col("value"), F.col("lo"), F.col("hi"), bins)))
    counts = values.join(F.broadcast(bounds), ["column", "class"]).groupBy(
        "column", "class", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    slots = bounds.withColumn("bin", F.explode(F.sequence(F.lit(-1), F.lit(bins))))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    inside = F.col("bin").between(0, bins - 1)
    return slots.join(F.broadcast(counts), ["column", "class", "bin"], "left").filter(
        inside | F.col("n").isNotNull()).select(
        "column", "class", F.col("bin").cast("long").alias("bin"),
        F.when(F.col("bin") >= 0, F.col("lo") + F.col("bin") * step).alias("bin_low"),
        F.when(F.col("bin") < bins, F.col("lo") + (F.col("bin") + 1) * step).alias("bin_high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distinct_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the sorted distinct values offered by each filter."""
    wide = df.select([F.col(c).cast("string").alias(c) for c in columns])
    return (wide.unpivot([], list(columns), "column", "value")
            .filter(F.col("value").isNotNull()).distinct().orderBy("column", "value"))


def feature_display_names(df: DataFrame, column: str = "feature") -> DataFrame:
    """Add `display_name`; a name without a display form stays as it is."""
    names = df.sparkSession.createDataFrame(
        list(FEATURE_NAMES.items()), f"{column} string, shown string")
    return df.join(F.broadcast(names), column, "left").withColumn(
        "display_name", F.coalesce("shown", column)).drop("shown")


def feature_coverage(df: DataFrame) -> DataFrame:
    """(feature, nulls, non_null, display_name) for every column of a feature table."""
    return feature_display_names(null_counts(df).withColumnRenamed("column", "feature"))


def above_median(df: DataFrame, column: str) -> DataFrame:
    """Flag the rows whose value exceeds the column's exact median."""
    median = exact_quantiles(df, [column], {"median": 0.5}).first()
    middle = F.lit(None if median is None else median["median"])
    return df.withColumn("above_median", F.col(column) > middle)
