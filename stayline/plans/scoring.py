"""One scoring plan for every entry point; the entry points differ in options.

A scorer offers `vocabulary`, `inputs`, and `churn(df)`, `clv(df)`,
`segment(df, clv_column)`, each adding columns: ChurnProb and ChurnPred, PredCLV,
Cluster and Segment. Everything stays one lazy plan.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.catalogue import CHURN_LABEL, CLV_LABEL
from stayline.functions import churn_status, long_date, money, percent, percent_text, round_even
from stayline.operators.offers import with_offer, with_short_offer
from stayline.operators.quality import (
    Vocabulary, apply_null_policy, fill_missing_columns, sanitize_categories,
)


class Scorer(Protocol):
    vocabulary: Vocabulary | DataFrame
    inputs: tuple[str, ...]

    def churn(self, df: DataFrame) -> DataFrame: ...

    def clv(self, df: DataFrame) -> DataFrame: ...

    def segment(self, df: DataFrame, clv: str) -> DataFrame: ...


def _clv_column(df: DataFrame, source: str) -> str:
    if source == "auto":
        return CLV_LABEL if CLV_LABEL in df.columns else "PredCLV"
    return {"actual": CLV_LABEL, "predicted": "PredCLV"}[source]


def score(
    df: DataFrame, scorer: Scorer, unknown: str | None = "first", clv_source: str = "auto",
    null_rows: str = "fail", fill: bool = True, clv_digits: int | None = None,
) -> DataFrame:
    """Reconcile the schema, then add churn, CLV and segment columns.

    `unknown=None` leaves categories as they are. `clv_source` says which CLV the
    segmentation uses: the label if present (`auto`), always the label (`actual`)
    or always the prediction (`predicted`).
    """
    if fill:
        df, _ = fill_missing_columns(df)
    df = apply_null_policy(df, null_rows)
    if unknown is not None:
        df = sanitize_categories(df, scorer.vocabulary, unknown)
    scored = scorer.clv(scorer.churn(df))
    if clv_digits is not None:
        scored = scored.withColumn("PredCLV", round_even(F.col("PredCLV"), clv_digits))
    return scorer.segment(scored, _clv_column(df, clv_source))


def score_dashboard(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Absent columns filled, unknown categories to the first label."""
    return score(df, scorer, unknown="first")


def score_bulk(df: DataFrame, scorer: Scorer, null_rows: str = "fail") -> tuple[DataFrame, list[str]]:
    """Scored upload with percent, status and one-line offer; and the filled columns.

    The prediction keeps its own column: an uploaded label is not overwritten.
    """
    _, filled = fill_missing_columns(df)
    scored = score(df, scorer, unknown="default", null_rows=null_rows, clv_digits=2)
    shown = scored.withColumns({
        "ChurnProbability": percent(F.col("ChurnProb")),
        "ChurnStatus": churn_status(F.col("ChurnPred")),
    })
    return with_short_offer(shown), filled


def bulk_export(scored: DataFrame) -> DataFrame:
    """The bulk report's own naming: the prediction under the label's name."""
    return scored.drop(CHURN_LABEL).withColumnRenamed("ChurnPred", CHURN_LABEL)


def score_retention(df: DataFrame, scorer: Scorer) -> DataFrame:
    """The default table: complete and clean, segmented on the actual CLV."""
    return score(df, scorer, unknown=None, clv_source="actual", null_rows="keep", fill=False)


def score_requests(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Request rows: known categories only, segmented on the predicted CLV."""
    return score(df, scorer, unknown=None, clv_source="predicted")


def customer_report(scored: DataFrame, report_date: str) -> DataFrame:
    """One formatted report row per scored request."""
    offered = with_offer(scored, style="single")
    plain = [
        "Gender", "Age", "Location", "PreferredCategory", "AppUsage", "MembershipPeriod",
        "TotalSpent", "PurchaseFrequency", "AvgOrderValue", "LastPurchaseDaysAgo",
        "CustomerSatisfaction", "ComplaintHistory", "CartAbandonRate",
    ]
    ids = [c for c in ("CustomerID",) if c in scored.columns]
    return offered.select(
        *ids, *plain,
        percent_text(F.col("ChurnProb") * F.lit(100.0), 2).alias("ChurnProbability"),
        churn_status(F.col("ChurnPred")).alias("Prediction"),
        money(F.col("PredCLV"), "Rs.").alias("PredictedCLV"),
        "Segment", F.col("Offer.tag").alias("RetentionOffer"),
        long_date(F.lit(report_date).cast("date")).alias("ReportDate"))
