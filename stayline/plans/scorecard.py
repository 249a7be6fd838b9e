"""A closed-form scorer: fixed weights, plain arithmetic, no fitted state.

It stands in for fitted models wherever a result must be reproducible to the bit
(engine cross-checks, tests). It makes no claim about any fitted model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.catalogue import RFM_BASE, SEGMENTS
from stayline.functions import at_most, churn_class, clamp
from stayline.operators.quality import Vocabulary
from stayline.operators.segments import with_segment

# (recency, frequency, spend, satisfaction, CLV) in standard units, one per segment.
CENTROIDS = (
    (-0.5, 1.0, 1.0, 0.3, 1.0),
    (-0.4, 0.0, 0.0, 0.6, 0.0),
    (-0.2, -0.3, -0.3, -0.8, -0.3),
    (1.5, -0.7, -0.9, 0.0, -0.8),
)
# Centre and spread of the same five measures.
UNITS = ((235.0, 210.0), (1.75, 0.6), (38000.0, 16000.0), (2.55, 0.86), (50000.0, 18000.0))


@dataclass(frozen=True)
class Scorecard:
    vocabulary: Vocabulary | DataFrame = field(default_factory=dict)
    inputs: tuple[str, ...] = (
        "LastPurchaseDaysAgo", "CustomerSatisfaction", "CartAbandonRate", "ComplaintHistory",
        "PurchaseFrequency", "TotalSpent", "AvgOrderValue",
    )

    def churn(self, df: DataFrame) -> DataFrame:
        recency = F.lit(0.45) * at_most(F.col("LastPurchaseDaysAgo"), 540) / F.lit(540.0)
        mood = F.lit(0.30) * (F.lit(5) - F.col("CustomerSatisfaction")) / F.lit(4.0)
        cart = F.lit(0.15) * F.col("CartAbandonRate")
        complaints = F.lit(0.10) * F.col("ComplaintHistory") / F.lit(4.0)
        prob = clamp(F.lit(0.10) + recency + mood + cart + complaints, 0.0, 1.0)
        return df.withColumn("ChurnProb", prob).withColumn(
            "ChurnPred", churn_class(F.col("ChurnProb")))

    def clv(self, df: DataFrame) -> DataFrame:
        return df.withColumn(
            "PredCLV", F.lit(0.8) * F.col("TotalSpent") + F.lit(4.0) * F.col("AvgOrderValue"))

    def segment(self, df: DataFrame, clv: str) -> DataFrame:
        """Nearest centroid; equal distances go to the lower cluster, unknown ones to none."""
        z = [(F.col(c) - F.lit(centre)) / F.lit(spread)
             for c, (centre, spread) in zip((*RFM_BASE, clv), UNITS)]
        distances = []
        for cluster, centroid in enumerate(CENTROIDS):
            total = None
            for part, centre in zip(z, centroid):
                gap = part - F.lit(centre)
                total = gap * gap if total is None else total + gap * gap
            distances.append(F.struct(total.alias("d"), F.lit(cluster).alias("cluster")))
        nearest = F.least(*distances)
        nearest = F.when(nearest["d"].isNotNull(), nearest["cluster"])
        return with_segment(df.withColumn("Cluster", nearest), dict(enumerate(SEGMENTS)))
