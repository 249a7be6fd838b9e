"""Filters, counts, rates, KPIs and ranked lists over a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.catalogue import ID
from stayline.functions import churn_status
from stayline.operators.order_stats import quantiles_of
from stayline.sources.staging import stage

ALL = "All"


def filter_equals(df: DataFrame, **values: object) -> DataFrame:
    """Keep rows equal to every value set; "All", None and absent columns do not filter."""
    for name, value in values.items():
        if value is not None and value != ALL and name in df.columns:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def at_risk(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ChurnPred") == 1)


def known_probability(df: DataFrame, column: str = "ChurnProbability") -> DataFrame:
    return df.dropna(subset=[column])


def retention_filter(
    df: DataFrame, segments: Sequence[str] = ("Lost", "At-Risk"), min_prob: float = 0.5,
    min_clv: float = 0.0,
) -> DataFrame:
    """At-risk rows in the segments (none named: any) reaching both minimums."""
    kept = at_risk(df)
    if segments:
        kept = kept.filter(F.col("Segment").isin(list(segments)))
    return kept.filter((F.col("ChurnProb") >= F.lit(float(min_prob)))
                       & (F.col("PredCLV") >= F.lit(float(min_clv))))


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column))


def count_by_status(df: DataFrame, pred: str = "ChurnPred") -> DataFrame:
    return count_by(df.select(churn_status(F.col(pred)).alias("status")), "status")


def churn_rate_by(df: DataFrame, key: str, by_rate: bool = False) -> DataFrame:
    """Mean prediction per key, ordered by rate or by key."""
    rates = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.avg("ChurnPred").alias("churn_rate"))
    return rates.orderBy(*(["churn_rate", key] if by_rate else [key]))


def revenue_at_risk_by_segment(df: DataFrame) -> DataFrame:
    return (at_risk(df).filter(F.col("Segment").isNotNull()).groupBy("Segment")
            .agg(F.sum("PredCLV").alias("revenue")).orderBy(F.desc("revenue")))


def _share(part: Column, whole: Column) -> Column:
    """Percentage; an empty whole gives 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * F.lit(100.0))


def kpi_dashboard(df: DataFrame) -> DataFrame:
    """Headline numbers of the (filtered) table; the mean CLV of no rows is null."""
    churned = F.col("ChurnPred") == 1
    sums = df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(churned).alias("at_risk"),
        F.coalesce(F.sum(F.when(churned, F.col("PredCLV"))), F.lit(0.0)).alias("revenue_at_risk"),
        F.avg("PredCLV").alias("avg_clv"),
        F.count_if(F.col("Segment") == "Champions").alias("champions"))
    return sums.withColumn("churn_pct", _share(F.col("at_risk"), F.col("customers")))


def kpi_bulk(df: DataFrame) -> DataFrame:
    """Headline numbers of an upload; churn figures over rows of known status."""
    churned = F.col("ChurnPred") == 1
    sums = df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("ChurnStatus") != "Unknown").alias("known"),
        F.count_if((F.col("ChurnStatus") != "Unknown") & churned).alias("will_churn"),
        F.coalesce(F.sum(F.when(churned, F.col("PredCLV"))), F.lit(0.0)).alias("revenue_at_risk"),
        F.coalesce(F.avg("PredCLV"), F.lit(0.0)).alias("avg_clv"))
    return sums.select(
        "customers", "will_churn", (F.col("known") - F.col("will_churn")).alias("will_return"),
        _share(F.col("will_churn"), F.col("known")).alias("churn_pct"), "revenue_at_risk", "avg_clv")


def kpi_retention(
    df: DataFrame, critical: float = 0.7, high_value_q: float = 0.75, exact: bool = True,
    accuracy: int = 10_000,
) -> DataFrame:
    """Headline numbers of the whole at-risk set, whatever the list filters are.

    High-value customers reach the set's own CLV quantile. The two columns it reads of the
    at-risk rows are staged, since the quantile takes a few passes. `exact=False` uses a
    bounded quantile sketch instead.
    """
    risky = stage(at_risk(df).select("ChurnProb", "PredCLV"))
    clv = F.col("PredCLV").cast("double")
    row = risky.agg(
        F.count(clv).alias("n"), F.min(clv).alias("low"), F.max(clv).alias("high"),
        *([] if exact else [F.percentile_approx(clv, high_value_q, accuracy).alias("q")])).first()
    if exact:
        limit = quantiles_of(
            risky, {"PredCLV": (row["n"], row["low"], row["high"])}, {"q": high_value_q})["PredCLV"]["q"]
    else:
        limit = row["q"]
    high = F.count_if(F.col("PredCLV") >= F.lit(limit).cast("double"))
    return risky.agg(
        F.count(F.lit(1)).alias("at_risk"),
        F.count_if(F.col("ChurnProb") >= F.lit(float(critical))).alias("critical"),
        high.alias("high_value"),
        F.coalesce(F.sum("PredCLV"), F.lit(0.0)).alias("revenue_at_risk"),
        (F.avg("ChurnProb") * 100.0).alias("avg_prob"))


def availability_flags(df: DataFrame) -> DataFrame:
    """Which report sections an upload can fill."""
    return df.agg(*[
        F.coalesce(F.bool_or(test), F.lit(False)).alias(name) for name, test in {
            "has_churn": F.col("ChurnStatus") != "Unknown",
            "has_segment": F.coalesce(F.col("Segment"), F.lit("Unknown")) != "Unknown",
            "has_clv": F.col("PredCLV").isNotNull(),
        }.items()])


def top_n(
    df: DataFrame, by: str | Column, n: int, tie: str = ID, columns: Sequence[str] | None = None
) -> DataFrame:
    """The n largest rows: every task keeps n, no full sort. Ties go to the lower id."""
    key = F.col(by) if isinstance(by, str) else by
    ties = [F.col(tie).asc()] if tie in df.columns else []
    ranked = df.orderBy(key.desc(), *ties).limit(n)
    return ranked.select([c for c in columns if c in df.columns]) if columns else ranked


def first_records(df: DataFrame, n: int = 100, columns: Sequence[str] | None = None) -> DataFrame:
    """The first n records by id, for display."""
    head = df.orderBy(ID).limit(n)
    return head.select([c for c in columns if c in df.columns]) if columns else head
