"""Column expressions shared by the operators; all run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(col: Column, digits: int = 0) -> Column:
    """Round half to even the way pandas does: scale, round to integer, unscale."""
    if digits == 0:
        return F.rint(col)
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def percent(prob: Column, digits: int = 2) -> Column:
    return round_even(prob * F.lit(100.0), digits)


def at_most(col: Column, high) -> Column:
    """Upper bound. Unlike `least`, a null stays null."""
    return F.when(col.isNotNull(), F.least(col, F.lit(high)))


def at_least(col: Column, low) -> Column:
    """Lower bound. Unlike `greatest`, a null stays null."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(low)))


def clamp(col: Column, low, high) -> Column:
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(high)), F.lit(low)))


def churn_class(prob: Column) -> Column:
    """1 above one half, else 0; unknown for an unknown probability."""
    return F.when(prob > F.lit(0.5), 1).when(prob.isNotNull(), 0)


def churn_status(pred: Column) -> Column:
    return (F.when(pred == 0, "Will Return").when(pred == 1, "Will Churn").otherwise("Unknown"))


def risk_band(prob: Column, low: float = 0.35, high: float = 0.65) -> Column:
    """Half-open bands: [0, low) Low, [low, high) Medium, [high, 1] High."""
    return (F.when(prob < F.lit(low), "Low").when(prob < F.lit(high), "Medium")
            .when(prob.isNotNull(), "High"))
