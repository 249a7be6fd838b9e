"""Retention offers by rule. Rules are evaluated top-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("premium_win_back", "win_back", "urgent", "nudge", "loyalty", "champions")

# Urgency per rule.
URGENCY = {
    "premium_win_back": "CRITICAL",
    "win_back": "HIGH",
    "urgent": "HIGH",
    "nudge": "MEDIUM",
    "loyalty": "LOW",
    "champions": "LOW",
}

# Tag and offers per rule, as listed for a whole customer base.
FULL_TEXTS = {
    "premium_win_back": ("🎁 Premium Win-Back", (
        "30% discount on next 3 orders", "Free priority shipping 3 months",
        "VIP membership upgrade", "Curated {category} deals")),
    "win_back": ("💌 Win-Back Campaign", (
        "20% discount (7 days)", "Free shipping next order",
        "New {category} arrivals", "200 loyalty points")),
    "urgent": ("⚠️ Urgent Retention", (
        "25% discount this week", "Double loyalty points",
        "Free express delivery 1 month", "Early sale access")),
    "nudge": ("🔔 Gentle Nudge", (
        "15% off next purchase", "Top {category} picks",
        "Loyalty points bonus", "48-hr flash sale invite")),
    "loyalty": ("⭐ Loyalty Reward", (
        "Free Gold membership 3 months", "Member-only discounts",
        "Early product launch access", "Refer & earn ₹500")),
    "champions": ("🏆 Champions Perk", (
        "Champions Club invitation", "Personal shopping assistant",
        "Limited edition early access", "Gift voucher ₹2000")),
}

# Title, offers and message per rule, as shown for a single customer.
SINGLE_TEXTS = {
    "premium_win_back": ("🎁 Premium Win-Back Offer", (
        "30% discount on next 3 orders", "Free priority shipping for 3 months",
        "Exclusive VIP membership upgrade", "Curated {category} deals"),
        "High-value lost customer. Aggressive win-back recommended."),
    "win_back": ("💌 Win-Back Campaign", (
        "20% discount coupon (valid 7 days)", "Free shipping on next order",
        "New {category} arrivals handpicked", "200 reactivation loyalty points"),
        "Customer has churned. Send re-engagement email immediately."),
    "urgent": ("⚠️ Urgent Retention Offer", (
        "25% discount this week", "Double loyalty points",
        "Free express delivery for 1 month", "Early access to upcoming sale"),
        "High churn probability. Immediate intervention needed."),
    "nudge": ("🔔 Re-Engagement Nudge", (
        "15% off next purchase", "Top {category} picks for you",
        "Loyalty points expiry bonus", "48-hour flash sale invite"),
        "Customer is drifting. A gentle nudge should bring them back."),
    "loyalty": ("⭐ Loyalty Reward", (
        "Free Gold membership for 3 months", "Member-only exclusive discounts",
        "Early product launch access", "Refer & earn ₹500"),
        "Loyal customer. Reward and strengthen the relationship."),
    "champions": ("🏆 Champions Club Invite", (
        "Champions Club invitation", "Personal shopping assistant",
        "Limited edition early access", "Annual gift voucher ₹2000"),
        "Top-tier customer. Keep them engaged with exclusive perks."),
}

# One-line offers of the bulk report.
SHORT_TEXTS = {
    "lost_high": "30% discount + Free shipping + VIP upgrade",
    "lost": "20% coupon + Free shipping + {category} picks",
    "at_risk_high": "25% off + Double points + Express delivery",
    "at_risk": "15% off + {category} top picks + Flash sale",
    "loyal": "Gold membership + Exclusive discounts",
    "other": "Champions Club invite + Gift voucher ₹2000",
}

_PLACE = "{category}"


def _worded(text: str, category: Column) -> Column:
    if _PLACE not in text:
        return F.lit(text)
    before, after = text.split(_PLACE)
    return F.concat(F.lit(before), category, F.lit(after))


def _category(df: DataFrame) -> Column:
    if "PreferredCategory" not in df.columns:
        return F.lit("General")
    return F.coalesce(F.col("PreferredCategory"), F.lit("General"))


def offer_rule(clv_threshold: float = 50000.0, prob_threshold: float = 0.7) -> Column:
    """Rule of each row. A segment that is unknown or null falls to the last rule."""
    segment, lost_value = F.col("Segment"), F.col("PredCLV") > F.lit(float(clv_threshold))
    likely = F.col("ChurnProb") > F.lit(float(prob_threshold))
    return (F.when((segment == "Lost") & lost_value, "premium_win_back")
            .when(segment == "Lost", "win_back")
            .when((segment == "At-Risk") & likely, "urgent")
            .when(segment == "At-Risk", "nudge")
            .when(segment == "Loyal", "loyalty")
            .otherwise("champions"))


def _by_rule(rule: Column, value_of) -> Column:
    chain = None
    for name in RULES:
        chain = (F if chain is None else chain).when(rule == name, value_of(name))
    return chain


def offer_columns(
    df: DataFrame, style: str = "full", clv_threshold: float = 50000.0,
    prob_threshold: float = 0.7,
) -> dict[str, Column]:
    """rule, tag, urgency, offers and message as expressions. `full` has no message."""
    texts = {"full": FULL_TEXTS, "single": SINGLE_TEXTS}[style]
    category, rule = _category(df), offer_rule(clv_threshold, prob_threshold)
    message = (_by_rule(rule, lambda n: F.lit(texts[n][2])) if style == "single"
               else F.lit(None).cast("string"))
    return {
        "rule": rule,
        "tag": _by_rule(rule, lambda n: F.lit(texts[n][0])),
        "urgency": _by_rule(rule, lambda n: F.lit(URGENCY[n])),
        "offers": _by_rule(rule, lambda n: F.array(*[_worded(t, category) for t in texts[n][1]])),
        "message": message,
    }


def with_offer(df: DataFrame, style: str = "full", **thresholds: float) -> DataFrame:
    """Add `Offer`: struct(rule, tag, urgency, offers, message)."""
    parts = offer_columns(df, style, **thresholds)
    return df.withColumn("Offer", F.struct(*[c.alias(n) for n, c in parts.items()]))


def short_offer(df: DataFrame, prob: Column, prob_threshold: float = 0.7) -> Column:
    """One-line offer; unlike the full rules, Lost splits on probability."""
    segment, category = F.col("Segment"), _category(df)
    likely = F.coalesce(prob, F.lit(0.0)) > F.lit(float(prob_threshold))
    text = {k: _worded(t, category) for k, t in SHORT_TEXTS.items()}
    return (F.when((segment == "Lost") & likely, text["lost_high"])
            .when(segment == "Lost", text["lost"])
            .when((segment == "At-Risk") & likely, text["at_risk_high"])
            .when(segment == "At-Risk", text["at_risk"])
            .when(segment == "Loyal", text["loyal"])
            .otherwise(text["other"]))


def with_short_offer(df: DataFrame, prob_threshold: float = 0.7) -> DataFrame:
    """Add `RetentionOffer` from `ChurnProbability` (percent, two decimals)."""
    prob = F.col("ChurnProbability") / F.lit(100.0)
    return df.withColumn("RetentionOffer", short_offer(df, prob, prob_threshold))


def urgency_counts(df: DataFrame, **thresholds: float) -> DataFrame:
    """Customers per urgency."""
    urgency = _by_rule(F.col("_rule"), lambda n: F.lit(URGENCY[n]))
    return (df.select(offer_rule(**thresholds).alias("_rule"))
            .groupBy(urgency.alias("urgency")).agg(F.count(F.lit(1)).alias("customers")))
