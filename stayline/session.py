"""Session builder with the settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE sizes shuffle partitions from measured bytes, splits skewed join
# partitions and turns a join into a broadcast only once the measured side is
# small. Nothing here fixes a partition count: that belongs to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Where every partition of the smaller side is measured to fit, join by hash
    # instead of sorting the line items.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    # Staged tables go with the last reference to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # No call-site capture for each column expression: plans here are built by code.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "stayline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
