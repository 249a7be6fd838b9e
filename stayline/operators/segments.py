"""Cluster profiles, average ranks, segment names and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.catalogue import CHURN_LABEL, CLV_LABEL, SEGMENTS
from stayline.functions import round_even


def cluster_profile(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Size and means per cluster, rounded as the segment naming expects."""
    means = {
        "Avg_Recency": "LastPurchaseDaysAgo", "Avg_Frequency": "PurchaseFrequency",
        "Avg_Spent": "TotalSpent", "Avg_Satisfaction": "CustomerSatisfaction",
        "Avg_CLV": CLV_LABEL, "Churn_Rate": CHURN_LABEL,
    }
    present = {out: src for out, src in means.items() if src in df.columns}

    def shown(mean: Column) -> Column:
        return mean if digits is None else round_even(mean, digits)

    return df.groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("Count"),
        *[shown(F.avg(src)).alias(out) for out, src in present.items()])


def average_rank(df: DataFrame, column: str, ascending: bool = True) -> Column:
    """Rank with ties sharing their mean rank, for frames of a few rows (one per cluster)."""
    value = F.col(column)
    order = value.asc() if ascending else value.desc()
    ties = F.count(F.lit(1)).over(W.partitionBy(column))
    return F.rank().over(W.orderBy(order)) + (ties - 1) / 2.0


def segment_rank(profile: DataFrame) -> DataFrame:
    """Average ranks of the clusters: CLV falling, churn rate rising, and their sum."""
    clv = average_rank(profile, "Avg_CLV", ascending=False)
    churn = average_rank(profile, "Churn_Rate", ascending=True)
    return profile.select("Cluster", "Avg_CLV", "Churn_Rate", clv.alias("clv_rank"),
                          churn.alias("churn_rank")).withColumn(
        "combined_rank", F.col("clv_rank") + F.col("churn_rank"))


def segment_map(profile: DataFrame, labels: Sequence[str] = SEGMENTS) -> DataFrame:
    """(Cluster, Segment): clusters by combined rank take the labels from best to worst.

    Equal ranks are settled by cluster id. At most len(labels) rows.
    """
    position = F.row_number().over(W.orderBy("combined_rank", "Cluster"))
    ranked = segment_rank(profile).select("Cluster", position.alias("position"))
    names = profile.sparkSession.createDataFrame(
        [(i + 1, s) for i, s in enumerate(labels)], "position int, Segment string")
    return ranked.join(F.broadcast(names), "position").select("Cluster", "Segment")


def with_segment(df: DataFrame, names: DataFrame | Mapping[int, str]) -> DataFrame:
    """Add the segment of each row's cluster; null where the cluster is not mapped.

    `names` has one row per segment label, so its broadcast is bounded.
    """
    if isinstance(names, Mapping):
        names = df.sparkSession.createDataFrame(list(names.items()), "Cluster int, Segment string")
    return df.join(F.broadcast(names), "Cluster", "left")


def clv_by_segment(df: DataFrame, clv: str = "PredCLV", keep_absent: bool = False) -> DataFrame:
    """Mean CLV in the fixed segment order; absent segments dropped or kept as null."""
    names = df.sparkSession.createDataFrame(
        [(i, s) for i, s in enumerate(SEGMENTS)], "position long, Segment string")
    means = df.groupBy("Segment").agg(F.avg(clv).alias("avg_clv"))
    joined = F.broadcast(names).join(means, "Segment", "left")
    if not keep_absent:
        joined = joined.filter(F.col("avg_clv").isNotNull())
    return joined.select("position", "Segment", "avg_clv").orderBy("position")
