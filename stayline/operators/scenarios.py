"""What-if actions for every customer at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.catalogue import ID
from stayline.functions import at_least, at_most, percent, round_even

# The actions, in display order.
ACTIONS = (
    ("Give Discount", {"disc": 1}),
    ("Satisfaction → 5", {"satisfaction": 5}),
    ("Satisfaction → 4", {"satisfaction": 4}),
    ("Cart Abandon → 0.1", {"cart_abandon": 0.1}),
    ("Visit Frequency +5", {"visit_freq_add": 5}),
    ("Last Purchase → 7 days", {"last_purchase": 7}),
    ("Complaints → 0", {"complaint_hist": 0}),
    ("All Actions Combined", {
        "disc": 1, "satisfaction": 5, "cart_abandon": 0.1, "visit_freq_add": 5,
        "last_purchase": 7, "complaint_hist": 0}),
)

_OVERRIDES = {
    "disc": ("DiscountUsed", "int"),
    "satisfaction": ("CustomerSatisfaction", "int"),
    "cart_abandon": ("CartAbandonRate", "double"),
    "visit_freq_add": ("VisitFrequency", "int"),
    "last_purchase": ("LastPurchaseDaysAgo", "int"),
    "complaint_hist": ("ComplaintHistory", "int"),
}
MAX_VISITS = 29

Actions = Sequence[tuple[str, Mapping[str, object]]]


def _action(position: int, label: str, overrides: Mapping[str, object]) -> Column:
    unknown = set(overrides) - set(_OVERRIDES)
    if unknown:
        raise ValueError(f"unknown overrides: {sorted(unknown)}")
    return F.struct(
        F.lit(position).cast("long").alias("position"), F.lit(label).alias("action"),
        *[F.lit(overrides.get(k)).cast(kind).alias(k) for k, (_, kind) in _OVERRIDES.items()])


def expand_scenarios(df: DataFrame, actions: Actions = ACTIONS) -> DataFrame:
    """One row per customer and action, inputs overridden; a null override keeps the base.

    The actions are a literal array exploded on each row: no join and no shuffle.
    Select the columns needed before calling, since each row is repeated.
    """
    listed = F.array(*[_action(i, label, o) for i, (label, o) in enumerate(actions)])
    rows = df.withColumn("_a", F.explode(listed))
    changed = {}
    for key, (column, kind) in _OVERRIDES.items():
        base, over = F.col(column), F.col(f"_a.{key}")
        if key == "visit_freq_add":
            # The bound applies to the action only, not to the base value.
            changed[column] = F.when(over.isNull(), base).otherwise(
                at_most(base + over, MAX_VISITS))
        else:
            changed[column] = F.coalesce(over, base)
        changed[column] = changed[column].cast(df.schema[column].dataType)
    return rows.withColumns({
        **changed, "position": F.col("_a.position"), "action": F.col("_a.action")}).drop("_a")


def _narrow(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    keep = [ID] + [c for c in needed if c != ID] + [
        c for c, _ in _OVERRIDES.values() if c not in needed]
    return df.select([c for c in keep if c in df.columns])


def score_scenarios(df: DataFrame, scorer, actions: Actions = ACTIONS) -> DataFrame:
    """(CustomerID, position, action, churn_pct, clv): every action scored."""
    rows = expand_scenarios(_narrow(df, scorer.inputs), actions)
    scored = scorer.clv(scorer.churn(rows))
    return scored.select(ID, "position", "action", percent(F.col("ChurnProb")).alias("churn_pct"),
                         round_even(F.col("PredCLV"), 2).alias("clv"))


def default_intervention(df: DataFrame) -> DataFrame:
    """The proposed intervention applied to each customer's inputs."""
    changed = {
        "DiscountUsed": F.lit(1),
        "CustomerSatisfaction": at_most(F.col("CustomerSatisfaction") + 1, 5),
        "CartAbandonRate": at_least(F.col("CartAbandonRate") - F.lit(0.2), 0.0),
        "VisitFrequency": at_most(F.col("VisitFrequency") + 3, MAX_VISITS),
        "LastPurchaseDaysAgo": at_least(F.col("LastPurchaseDaysAgo") - 15, 1),
        "ComplaintHistory": at_least(F.col("ComplaintHistory") - 1, 0),
    }
    return df.withColumns({c: e.cast(df.schema[c].dataType) for c, e in changed.items()})


def intervention_impact(df: DataFrame, scorer) -> DataFrame:
    """Churn percent and CLV before and after the intervention, on the same row."""
    base = scorer.clv(scorer.churn(_narrow(df, scorer.inputs)))
    kept = base.withColumns({
        "before_pct": percent(F.col("ChurnProb")),
        "before_clv": round_even(F.col("PredCLV"), 2),
    }).drop("ChurnProb", "ChurnPred", "PredCLV")
    after = scorer.clv(scorer.churn(default_intervention(kept)))
    out = after.withColumns({
        "after_pct": percent(F.col("ChurnProb")), "after_clv": round_even(F.col("PredCLV"), 2)})
    return out.select(
        ID, "before_pct", "after_pct",
        (F.col("before_pct") - F.col("after_pct")).alias("risk_reduction"),
        "before_clv", "after_clv", (F.col("after_clv") - F.col("before_clv")).alias("clv_change"))


def sensitivity(df: DataFrame, scorer, actions: Actions = ACTIONS) -> DataFrame:
    """(CustomerID, position, action, base_pct, churn_pct, reduction) for every action.

    The base is scored once per customer, before the rows are repeated. Actions
    that do not help stay in.
    """
    base = scorer.churn(_narrow(df, scorer.inputs)).withColumn(
        "base_pct", percent(F.col("ChurnProb"))).drop("ChurnProb", "ChurnPred")
    scored = scorer.churn(expand_scenarios(base, actions)).withColumn(
        "churn_pct", percent(F.col("ChurnProb")))
    return scored.select(
        ID, "position", "action", "base_pct", "churn_pct",
        round_even(F.col("base_pct") - F.col("churn_pct"), 2).alias("reduction"))


def best_action(effects: DataFrame) -> DataFrame:
    """The action of largest reduction per customer; the earlier action wins ties.

    A customer's rows leave `expand_scenarios` together, so map-side aggregation
    reduces them to one before the exchange.
    """
    best = F.max(F.struct("reduction", (-F.col("position")).alias("rank"), "action", "churn_pct"))
    return effects.groupBy(ID).agg(best.alias("b")).select(
        ID, F.col("b.action").alias("action"), F.col("b.reduction").alias("reduction"),
        F.col("b.churn_pct").alias("churn_pct"))


def action_summary(effects: DataFrame) -> DataFrame:
    """Effect of each action over the whole base."""
    return effects.groupBy("position", "action").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("reduction") > 0).alias("helped"),
        F.avg("reduction").alias("mean_reduction")).orderBy("position")
