"""The ranked retention list."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions import percent
from stayline.operators.offers import offer_columns
from stayline.operators.reports import retention_filter, top_n
from stayline.sources.exports import RETENTION_COLUMNS

SORTS = {"revenue": "PredCLV", "probability": "ChurnProb"}


def retention_report(
    scored: DataFrame, segments: Sequence[str] = ("Lost", "At-Risk"), min_prob: float = 0.5,
    min_clv: float = 0.0, sort_by: str = "revenue", n: int = 50, details: bool = False,
    late: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """At-risk customers worth acting on, best first, with their offers.

    Offers are worded after the cut, so only the listed rows carry text. With
    `details`, urgency and the offer list are added to the report columns. `late`
    adds columns to the listed rows that the ranking doesn't need.
    """
    listed = top_n(retention_filter(scored, segments, min_prob, min_clv), SORTS[sort_by], n)
    if late is not None:
        listed = top_n(late(listed), SORTS[sort_by], n)  # a join keeps no order
    offer = offer_columns(listed)
    computed = {"ChurnProbability": percent(F.col("ChurnProb")), "RetentionOffer": offer["tag"]}
    report = [computed[c].alias(c) if c in computed else c
              for c in RETENTION_COLUMNS if c in computed or c in listed.columns]
    if details:
        report += [offer["urgency"].alias("Urgency"), offer["offers"].alias("Offers")]
    # A single projection over the limit: Spark then keeps n rows per task
    # (TakeOrderedAndProject) instead of sorting the whole at-risk set.
    return listed.select(*report)
