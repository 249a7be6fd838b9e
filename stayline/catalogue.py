"""The customer schema: supported columns, defaults, feature lists, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    spark_type: str
    default: object


# The supported input columns, their kinds and their defaults.
CUSTOMER_COLUMNS = (
    ColumnSpec("Gender", "categorical", "string", "Male"),
    ColumnSpec("Age", "numeric", "int", 38),
    ColumnSpec("Location", "categorical", "string", "Mumbai"),
    ColumnSpec("MembershipPeriod", "numeric", "int", 24),
    ColumnSpec("PreferredCategory", "categorical", "string", "Electronics"),
    ColumnSpec("VisitFrequency", "numeric", "int", 10),
    ColumnSpec("AvgSessionTime", "numeric", "double", 20.0),
    ColumnSpec("PagesViewed", "numeric", "int", 8),
    ColumnSpec("PurchaseFrequency", "numeric", "double", 5.0),
    ColumnSpec("AvgOrderValue", "numeric", "double", 2000.0),
    ColumnSpec("TotalSpent", "numeric", "double", 25000.0),
    ColumnSpec("LastPurchaseDaysAgo", "numeric", "int", 45),
    ColumnSpec("DiscountUsed", "numeric", "int", 0),
    ColumnSpec("CustomerSatisfaction", "numeric", "int", 3),
    ColumnSpec("ReturnCount", "numeric", "int", 3),
    ColumnSpec("ComplaintHistory", "numeric", "int", 1),
    ColumnSpec("AppUsage", "categorical", "string", "Medium"),
    ColumnSpec("CartAbandonRate", "numeric", "double", 0.4),
)

ID = "CustomerID"
CHURN_LABEL = "ChurnRisk"
CLV_LABEL = "CLV"
NON_FEATURES = (ID, CLV_LABEL, CHURN_LABEL)

INPUT_NAMES = tuple(c.name for c in CUSTOMER_COLUMNS)
CATEGORICAL = tuple(c.name for c in CUSTOMER_COLUMNS if c.kind == "categorical")
NUMERIC = tuple(c.name for c in CUSTOMER_COLUMNS if c.kind == "numeric")
DEFAULT_OF = {c.name: c.default for c in CUSTOMER_COLUMNS}
TYPE_OF = {c.name: c.spark_type for c in CUSTOMER_COLUMNS}

# Names of the label-encoded columns.
ENCODED = {
    "Gender": "Gender_enc",
    "Location": "Location_enc",
    "PreferredCategory": "Category_enc",
    "AppUsage": "AppUsage_enc",
}

# Inputs of the three models.
CHURN_FEATURES = (
    "Age", "MembershipPeriod", "VisitFrequency", "AvgSessionTime", "PagesViewed",
    "PurchaseFrequency", "AvgOrderValue", "TotalSpent", "LastPurchaseDaysAgo",
    "DiscountUsed", "CustomerSatisfaction", "ReturnCount", "ComplaintHistory",
    "CartAbandonRate", "Gender_enc", "Location_enc", "Category_enc", "AppUsage_enc",
)
CLV_FEATURES = (
    "Age", "MembershipPeriod", "PurchaseFrequency", "AvgOrderValue", "TotalSpent",
    "CustomerSatisfaction", "ReturnCount", "VisitFrequency", "DiscountUsed",
)
RFM_BASE = ("LastPurchaseDaysAgo", "PurchaseFrequency", "TotalSpent", "CustomerSatisfaction")
RFM_FEATURES = RFM_BASE + (CLV_LABEL,)

# Segments from best to worst.
SEGMENTS = ("Champions", "Loyal", "At-Risk", "Lost")

# Display names of the churn features.
FEATURE_NAMES = {
    "CartAbandonRate": "Cart Abandon Rate",
    "CustomerSatisfaction": "Customer Satisfaction",
    "LastPurchaseDaysAgo": "Last Purchase (days)",
    "ComplaintHistory": "Complaint History",
    "TotalSpent": "Total Spent",
    "PurchaseFrequency": "Purchase Frequency",
    "AvgOrderValue": "Avg Order Value",
    "MembershipPeriod": "Membership Period",
    "VisitFrequency": "Visit Frequency",
    "Age": "Age",
    "AppUsage_enc": "App Usage",
    "Location_enc": "Location",
    "Category_enc": "Category",
    "Gender_enc": "Gender",
    "AvgSessionTime": "Avg Session Time",
    "PagesViewed": "Pages Viewed",
    "ReturnCount": "Return Count",
    "DiscountUsed": "Discount Used",
}


def customer_schema(with_labels: bool = True) -> T.StructType:
    """Explicit read schema: id, the 18 inputs and, on request, the two labels."""
    fields = [f"{ID} long"] + [f"{c.name} {c.spark_type}" for c in CUSTOMER_COLUMNS]
    if with_labels:
        fields += [f"{CHURN_LABEL} int", f"{CLV_LABEL} double"]
    return T.StructType.fromDDL(", ".join(fields))


def used_by(name: str) -> list[str]:
    """Models that read an input column."""
    encoded = ENCODED.get(name, name)
    uses = [("Churn", CHURN_FEATURES), ("CLV", CLV_FEATURES), ("Segmentation", RFM_FEATURES)]
    return [model for model, features in uses if encoded in features]
