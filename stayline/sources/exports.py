"""CSV reports. Each task writes its own part file; nothing is gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Columns of the reports, in order.
DASHBOARD_COLUMNS = (
    "CustomerID", "Gender", "Age", "Location", "PreferredCategory", "TotalSpent",
    "CustomerSatisfaction", "Segment", "ChurnProb", "PredCLV",
)
BULK_COLUMNS = (
    "CustomerID", "Gender", "Age", "Location", "PreferredCategory", "TotalSpent",
    "CustomerSatisfaction", "ChurnProbability", "ChurnStatus", "PredCLV", "Segment",
    "RetentionOffer",
)
TOP_RISK_COLUMNS = (
    "CustomerID", "Age", "Location", "PreferredCategory", "TotalSpent",
    "ChurnProbability", "PredCLV", "Segment", "RetentionOffer",
)
RETENTION_TABLE_COLUMNS = (
    "CustomerID", "Age", "Gender", "Location", "PreferredCategory", "TotalSpent",
    "CustomerSatisfaction", "ChurnProb", "PredCLV", "Segment",
)
RETENTION_COLUMNS = (
    "CustomerID", "Age", "Gender", "Location", "PreferredCategory", "TotalSpent",
    "Segment", "ChurnProbability", "PredCLV", "RetentionOffer",
)


def select_present(df: DataFrame, want: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that the table has, in the wanted order."""
    return df.select([c for c in want if c in df.columns])


def export_csv(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists"
) -> None:
    out = select_present(df, columns) if columns else df
    out.write.mode(mode).option("header", True).csv(path)
