"""Exact order statistics without a single-task sort.

A running total over a whole table usually means one window without partitions,
hence one task. Here the rows are range-partitioned on the sort key, each row is
tagged with its range, and the tagged table is staged, which fixes the tags.
Ranges are then summed (one row per range), the sums are accumulated, and every
range continues from its offset in parallel.

Quantiles need no order of the whole table: a sketch brackets each rank, the rows
around the bracket are counted, and only the few values inside it are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayline.sources.staging import stage

_RANGE = "_range"


def running_totals(
    df: DataFrame, order: str, totals: Sequence[str], by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add `cum_<t>` for each total, accumulated in `order` within each `by`.

    `df` must hold one row per (by, order), as a groupBy leaves it; so no range
    can be dominated by copies of one key.
    """
    by = list(by)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    ranged = stage(
        df.repartitionByRange(*by, direction).withColumn(_RANGE, F.spark_partition_id()))

    keys = by + [_RANGE]
    before = W.partitionBy(*by).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in totals])
    offsets = sums.select(
        *[F.col(k).alias(f"_at_{k}") for k in keys],
        *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"_off_{t}") for t in totals])

    # Null-safe, so that a null group keeps its rows.
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    upto = W.partitionBy(*keys).orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranged.join(offsets, reduce(and_, same)).select(*df.columns, *[
        (F.col(f"_off_{t}") + F.sum(t).over(upto)).alias(f"cum_{t}") for t in totals])


@dataclass(frozen=True)
class _Bracket:
    """Values that hold the ranks `first` to `last` (zero-based); `below` rows are smaller, `rows` inside."""

    column: str
    first: int
    last: int
    low: float
    high: float
    below: int
    rows: int

    def holds(self, value: Column) -> Column:
        return value.between(F.lit(self.low), F.lit(self.high))

    def shares(self, slack: float) -> list[float]:
        """Where the ranks lie among the rows inside, with room for the sketch's error."""
        low = (self.first - self.below) / self.rows - slack
        return [max(0.0, low), min(1.0, (self.last - self.below + 1) / self.rows + slack)]


def _narrowed(values: DataFrame, brackets: list[_Bracket], accuracy: int) -> list[_Bracket]:
    """Each bracket cut to the values a sketch of its rows names, where they do hold the ranks.

    Two passes of partial aggregates, one row each.
    """
    inside = [F.when(b.holds(F.col(b.column)), F.col(b.column)) for b in brackets]
    guess = values.agg(*[
        F.percentile_approx(v, b.shares(2.0 / accuracy), accuracy).alias(f"g{i}")
        for i, (b, v) in enumerate(zip(brackets, inside, strict=True))]).first()
    ends = [guess[f"g{i}"] for i in range(len(brackets))]
    counts = values.agg(*[
        F.count_if(test).alias(f"n{i}_{name}")
        for i, (v, (low, high)) in enumerate(zip(inside, ends, strict=True))
        for name, test in (("below", v < F.lit(low)), ("upto", v <= F.lit(high)))]).first()
    out = []
    for i, (b, (low, high)) in enumerate(zip(brackets, ends, strict=True)):
        below, upto = b.below + counts[f"n{i}_below"], b.below + counts[f"n{i}_upto"]
        if below > b.first:
            low, below = b.low, b.below
        if upto <= b.last:
            high, upto = b.high, b.below + b.rows
        out.append(_Bracket(b.column, b.first, b.last, low, high, below, upto - below))
    return out


def _ranked(values: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """(column, rank) to value, for the first and last rank of each bracket.

    Equal values are combined before the exchange; a bracket is then ordered in one task.
    """
    places = {place: i for i, place in enumerate(dict.fromkeys((b.column, b.low, b.high, b.below) for b in brackets))}
    of = [places[b.column, b.low, b.high, b.below] for b in brackets]
    slots = [
        F.when(F.col(c).between(F.lit(low), F.lit(high)), F.struct(F.lit(i).alias("slot"), F.col(c).alias("value")))
        for (c, low, high, _), i in places.items()]
    counts = values.select(F.inline(F.array_compact(F.array(*slots)))).groupBy("slot", "value").agg(
        F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("slot").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    wanted = values.sparkSession.createDataFrame(
        sorted({(slot, b.column, rank, rank - b.below) for slot, b in zip(of, brackets, strict=True)
                for rank in (b.first, b.last)}),
        "slot int, column string, rank long, nth long")
    # Two ranks a bracket, so the broadcast and the result are bounded by the quantiles asked for.
    found = counts.withColumn("cum", F.sum("n").over(upto)).join(F.broadcast(wanted), "slot").filter(
        (F.col("nth") < F.col("cum")) & (F.col("nth") >= F.col("cum") - F.col("n")))
    return {(r["column"], r["rank"]): r["value"] for r in found.select("column", "rank", "value").collect()}


def quantiles_of(
    df: DataFrame, sizes: Mapping[str, tuple[int, float, float]], probs: Mapping[str, float],
    accuracy: int = 10_000, at_once: int = 100_000,
) -> dict[str, dict[str, float | None]]:
    """Exact linear-interpolation quantiles (as pandas) of numeric columns, nulls aside.

    `sizes` has the known values, the least and the greatest of each column. Brackets of
    over `at_once` rows are narrowed by sketches, each to about 4 / `accuracy` of its rows, until
    they are small or hold one value; so neither an outlier nor a dominant value matters.
    `df` is read three times, or two more for each further narrowing; nothing of its size
    is exchanged.
    """
    values = df.select([F.col(c).cast("double").alias(c) for c in sizes])
    brackets, at = [], {}
    for column, (size, low, high) in sizes.items():
        for name, p in probs.items():
            if size:
                position = float(p) * (size - 1)
                at[column, name] = position, len(brackets)
                brackets.append(_Bracket(column, math.floor(position), math.ceil(position), low, high, 0, size))
    wide = {i: b for i, b in enumerate(brackets) if b.rows > at_once and b.low != b.high}
    while wide:
        cut = dict(zip(wide, _narrowed(values, list(wide.values()), accuracy), strict=True))
        for i, b in cut.items():
            brackets[i] = b
        # A bracket that did not shrink holds few distinct values, which combine before the exchange.
        wide = {i: b for i, b in cut.items() if at_once < b.rows < wide[i].rows and b.low != b.high}
    found = _ranked(values, brackets) if brackets else {}

    def value(column: str, name: str) -> float | None:
        if (column, name) not in at:
            return None
        position, i = at[column, name]
        low, high = found[column, brackets[i].first], found[column, brackets[i].last]
        return low + (high - low) * (position - brackets[i].first) if low != high else low

    return {c: {name: value(c, name) for name in probs} for c in sizes}


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], at_once: int = 100_000,
) -> DataFrame:
    """(column, <name of each prob>): exact quantiles of several columns; a column without a value has none."""
    ends = df.agg(*[
        f(F.col(c).cast("double")).alias(f"{f.__name__}_{i}")
        for i, c in enumerate(columns) for f in (F.count, F.min, F.max)]).first()
    sizes = {c: (ends[f"count_{i}"], ends[f"min_{i}"], ends[f"max_{i}"])
             for i, c in enumerate(columns) if ends[f"count_{i}"]}
    found = quantiles_of(df, sizes, probs, at_once=at_once)
    return df.sparkSession.createDataFrame(
        [(c, *found[c].values()) for c in found],
        ", ".join(["column string", *[f"{name} double" for name in probs]]))
