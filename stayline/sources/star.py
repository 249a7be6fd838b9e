"""The customer table derived from order, line-item, part and event tables.

Shape of the plan: each fact table is reduced to one row per customer by a
map-side-combined aggregation on the customer key, and the reduced sides are
joined on that same key, so those joins reuse the aggregations' partitioning.
Line items meet their orders on the order key (one exchange each, skewed
partitions split by AQE). No broadcast is hinted: dimension tables are broadcast
only when Spark's own size check allows it.

Branches that feed no requested column are left out of the plan. Catalyst cannot
drop a join on its own when it does not know the key to be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.catalogue import CHURN_LABEL, CLV_LABEL, DEFAULT_OF, ID, INPUT_NAMES
from stayline.functions import clamp

Tables = Callable[[str], DataFrame]

AS_OF = "2000-01-01"
LABEL_DAYS = 180
MONEY_UNIT = 50.0

VIEW_COLUMNS = (ID,) + INPUT_NAMES + (CHURN_LABEL, CLV_LABEL)

_LINE_COLUMNS = {"PreferredCategory", "DiscountUsed", "CustomerSatisfaction", "ReturnCount"}
_EVENT_COLUMNS = {
    "VisitFrequency", "AvgSessionTime", "PagesViewed", "ComplaintHistory", "AppUsage",
    "CartAbandonRate",
}


def star_tables(spark: SparkSession, folder: str) -> Tables:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def _hundredths(col: Column) -> Column:
    """Two-decimal amounts as whole hundredths: exact sums on primitive longs."""
    return F.round(col * F.lit(100.0)).cast("long")


def _units(hundredths: Column) -> Column:
    return hundredths.cast("double") / F.lit(100.0)


def _order_facts(tables: Tables, as_of: str) -> DataFrame:
    day = F.col("day")
    prior = day < F.lit(as_of).cast("date")
    label = ~prior & (day < F.date_add(F.lit(as_of).cast("date"), LABEL_DAYS))
    orders = tables("orders").select(
        F.col("o_custkey").alias(ID),
        F.col("o_orderdate").cast("date").alias("day"),
        _hundredths(F.col("o_totalprice")).alias("amount"),
    )
    return orders.groupBy(ID).agg(
        F.count_if(prior).alias("prior_orders"),
        F.min(F.when(prior, day)).alias("first_day"),
        F.max(F.when(prior, day)).alias("last_day"),
        F.sum(F.when(prior, F.col("amount"))).alias("prior_amount"),
        F.sum("amount").alias("all_amount"),
        F.count_if(label).alias("label_orders"),
    ).filter(F.col("prior_orders") > 0)


def _line_facts(tables: Tables, as_of: str, with_category: bool) -> DataFrame:
    prior = tables("orders").filter(
        F.col("o_orderdate") < F.lit(as_of).cast("timestamp_ntz")
    ).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias(ID))
    lines = tables("lineitem").join(prior, "l_orderkey")
    measures = [
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("returns"),
        F.sum(_hundredths(F.col("l_discount"))).alias("discount"),
    ]
    if not with_category:
        return lines.groupBy(ID).agg(*measures)
    category = tables("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    per_category = lines.join(category, "l_partkey", "left").groupBy(ID, "p_type").agg(
        *measures, F.sum(_hundredths(F.col("l_extendedprice"))).alias("revenue"))
    # Largest revenue wins, ties go to the first name: the smallest (-revenue, name).
    best = F.min(F.when(F.col("p_type").isNotNull(), F.struct(-F.col("revenue"), F.col("p_type"))))
    return per_category.groupBy(ID).agg(
        F.sum("lines").alias("lines"),
        F.sum("returns").alias("returns"),
        F.sum("discount").alias("discount"),
        best["p_type"].alias("category"),
    )


def _event_facts(tables: Tables) -> DataFrame:
    kind = F.col("event_type")
    return tables("events").groupBy(F.col("user_id").alias(ID)).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "purchase").alias("purchases"),
        F.count_if(kind == "error").alias("errors"),
        F.sum(_hundredths(F.col("value"))).alias("value"),
    )


def customer_view(
    tables: Tables, columns: Sequence[str] | None = None, as_of: str = AS_OF,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per customer with an order before `as_of`, in the customer schema.

    `columns` names the view columns wanted; `extra` passes customer-table columns
    through. PreferredCategory is null when no line item of a customer has a part.
    """
    want = list(columns or VIEW_COLUMNS)
    cutoff = F.lit(as_of).cast("date")
    default = {k: F.lit(v) for k, v in DEFAULT_OF.items()}

    # Nations are looked up before the customer key is used, so the joins on that
    # key follow one another without a new exchange.
    accounts = tables("customer").withColumnRenamed("c_custkey", ID)
    if "Location" in want:
        accounts = accounts.join(
            tables("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"),
            "c_nationkey", "left")
    df = _order_facts(tables, as_of).join(accounts, ID)
    if _LINE_COLUMNS & set(want):
        df = df.join(_line_facts(tables, as_of, "PreferredCategory" in want), ID, "left")
    if _EVENT_COLUMNS & set(want):
        df = df.join(_event_facts(tables), ID, "left")

    key, col = F.col(ID), F.col
    months = F.greatest(F.lit(1), F.floor(F.datediff(cutoff, col("first_day")) / 30).cast("int"))
    spent = _units(col("prior_amount")) / F.lit(MONEY_UNIT)
    some_events, some_lines = col("events") > 0, col("lines") > 0
    spenders = col("clicks") + col("purchases")
    rules = {
        ID: key,
        "Gender": F.when(key % 2 == 0, "Male").otherwise("Female"),
        "Age": (F.lit(18) + (key * 7) % 47).cast("int"),
        "Location": col("n_name"),
        "MembershipPeriod": months,
        "PreferredCategory": col("category"),
        "VisitFrequency": F.when(some_events, F.least(F.lit(29), col("views")))
        .otherwise(default["VisitFrequency"]).cast("int"),
        "AvgSessionTime": F.coalesce(
            clamp(_units(col("value")) / col("events"), 2.0, 45.0), default["AvgSessionTime"]),
        "PagesViewed": F.when(some_events, F.least(F.lit(19), col("clicks")))
        .otherwise(default["PagesViewed"]).cast("int"),
        "PurchaseFrequency": (F.lit(12) * col("prior_orders")).cast("double") / months,
        "AvgOrderValue": spent / col("prior_orders"),
        "TotalSpent": spent,
        "LastPurchaseDaysAgo": F.datediff(cutoff, col("last_day")),
        "DiscountUsed": F.when(some_lines & (col("discount") >= 5 * col("lines")), 1).otherwise(0),
        "CustomerSatisfaction": F.when(
            some_lines,
            F.greatest(F.lit(1), F.least(
                F.lit(5), F.lit(6) - F.ceil((F.lit(9) * col("returns")) / col("lines")))),
        ).otherwise(default["CustomerSatisfaction"]).cast("int"),
        "ReturnCount": F.when(some_lines, col("returns"))
        .otherwise(default["ReturnCount"]).cast("int"),
        "ComplaintHistory": F.when(
            some_events, F.least(F.lit(4), F.floor(col("errors") / 5)))
        .otherwise(default["ComplaintHistory"]).cast("int"),
        "AppUsage": F.when(col("events") < 60, "Low").when(col("events") < 74, "Medium")
        .when(some_events, "High").otherwise(default["AppUsage"]),
        "CartAbandonRate": F.when(
            some_events & (spenders > 0), col("clicks").cast("double") / spenders)
        .otherwise(default["CartAbandonRate"]),
        CHURN_LABEL: F.when(col("label_orders") == 0, 1).otherwise(0),
        CLV_LABEL: _units(col("all_amount")) / F.lit(MONEY_UNIT),
    }
    return df.select(*[rules[c].alias(c) for c in want], *extra)


#: Where a table names the customer; line items are reached through their orders.
_CUSTOMER_KEYS = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"}


#: Lists of customers up to so many bytes of keys are sent to every task.
BROADCAST_BYTES = 8 << 20
_KEY_BYTES = 32


def with_view_columns(listed: DataFrame, tables: Tables, columns: Sequence[str]) -> DataFrame:
    """Add view columns to a list of customers, derived for those customers alone.

    The list is counted and read several times: stage it. Its keys are broadcast up to a measured
    size; a longer list filters the tables by a shuffled semi join on the customer key, before they are
    aggregated on that key. Repeated customers each get the columns, a customer without a prior order
    keeps nulls, and an empty list stays one.
    """
    few = listed.count() * _KEY_BYTES <= BROADCAST_BYTES

    def of_listed(name: str) -> DataFrame:
        key = _CUSTOMER_KEYS.get(name)
        if key is None:
            return tables(name)
        keys = listed.select(F.col(ID).alias(key))
        keys = F.broadcast(keys) if few else keys.distinct().hint("shuffle_merge")
        return tables(name).join(keys, key, "left_semi")

    return listed.join(customer_view(of_listed, (ID, *columns)), ID, "left")


# Columns a partner system supplies; the rest of the catalogue is absent.
PARTNER_COLUMNS = (
    ID, "Gender", "Age", "Location", "PreferredCategory", "PurchaseFrequency",
    "AvgOrderValue", "TotalSpent", "LastPurchaseDaysAgo", "CustomerSatisfaction", "AppUsage",
)


def partner_base(tables: Tables) -> DataFrame:
    """The clean columns behind an upload, with the account columns it carries along."""
    return customer_view(tables, PARTNER_COLUMNS, extra=("c_acctbal", "c_mktsegment"))


def partner_upload(base: DataFrame) -> DataFrame:
    """An upload as another system would send it, derived from the same tables.

    Ten catalogue columns, two unknown columns, no labels. Accounts in debt carry
    an unknown gender code, no location and no app usage; accounts below 1000
    carry the market segment where the category belongs.
    """
    balance = F.col("c_acctbal")
    in_debt = balance < F.lit(0.0)
    return base.withColumns({
        "Gender": F.when(in_debt, "U").otherwise(F.col("Gender")),
        "Location": F.when(~in_debt, F.col("Location")),
        "PreferredCategory": F.when(balance < F.lit(1000.0), F.col("c_mktsegment"))
        .otherwise(F.col("PreferredCategory")),
        "AppUsage": F.when(~in_debt, F.col("AppUsage")),
    }).withColumnsRenamed({"c_acctbal": "AccountBalance", "c_mktsegment": "MarketSegment"})
