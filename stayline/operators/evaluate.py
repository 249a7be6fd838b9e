"""Model evaluation from (label, prediction, score) tables; positive class is 1."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.catalogue import CHURN_LABEL, CLV_LABEL, ID
from stayline.operators.order_stats import running_totals


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _cells(label: str, pred: str) -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [F.count_if((y == a) & (p == b)).alias(n)
            for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def classification_metrics(
    df: DataFrame, label: str = CHURN_LABEL, pred: str = "ChurnPred", by: Sequence[str] = ()
) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    cells = df.groupBy(*by).agg(*_cells(label, pred))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return cells.select(
        *by, (tn + fp + fn + tp).alias("n"),
        _ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        _ratio(tp * 2.0, tp * 2 + fp + fn).alias("f1"))


def confusion_matrix(
    df: DataFrame, label: str = CHURN_LABEL, pred: str = "ChurnPred", by: Sequence[str] = ()
) -> DataFrame:
    """(*by, actual, predicted, n, correct): always the four cells of each group."""
    cells = df.groupBy(*by).agg(*_cells(label, pred))
    rows = [F.struct(F.lit(a).cast("long").alias("actual"), F.lit(b).cast("long").alias("predicted"),
                     F.col(n).alias("n"), F.lit(a == b).alias("correct"))
            for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    return cells.select(*by, F.inline(F.array(*rows)))


def classification_report(
    df: DataFrame, label: str = CHURN_LABEL, pred: str = "ChurnPred", by: Sequence[str] = ()
) -> DataFrame:
    """(*by, class, precision, recall, f1, support): both classes, accuracy and the averages.

    The accuracy row carries the accuracy as `f1`, as the printed report does.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    per = {
        "p0": _ratio(tn, tn + fn), "r0": _ratio(tn, tn + fp),
        "f0": _ratio(tn * 2.0, tn * 2 + fn + fp), "s0": tn + fp,
        "p1": _ratio(tp, tp + fp), "r1": _ratio(tp, tp + fn),
        "f1": _ratio(tp * 2.0, tp * 2 + fp + fn), "s1": fn + tp,
        "n": n, "acc": _ratio(tn + tp, n),
    }
    cells = df.groupBy(*by).agg(*_cells(label, pred))
    one = cells.select(*by, *[v.alias(k) for k, v in per.items()])

    def mean(k: str, weighted: bool) -> Column:
        a, b = F.col(f"{k}0"), F.col(f"{k}1")
        if weighted:
            return _ratio(a * F.col("s0") + b * F.col("s1"), F.col("n"))
        return (a + b) / 2.0

    none = F.lit(None).cast("double")
    lines = [
        ("Will Return", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        ("Will Churn", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        ("accuracy", none, none, F.col("acc"), F.col("n")),
        ("macro avg", mean("p", False), mean("r", False), mean("f", False), F.col("n")),
        ("weighted avg", mean("p", True), mean("r", True), mean("f", True), F.col("n")),
    ]
    return one.select(*by, F.inline(F.array(*[
        F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                 f.alias("f1"), s.alias("support")) for name, p, r, f, s in lines])))


def _score_groups(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: partial aggregation absorbs hot scores."""
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        *by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _roc_totals(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    return running_totals(
        _score_groups(df, label, score, by), "threshold", ["pos", "neg"], by, descending=True)


def roc_curve(
    df: DataFrame, label: str = CHURN_LABEL, score: str = "ChurnProb", origin: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """(*by, threshold, tp, fp, tpr, fpr) at every distinct score, and the origin at +infinity.

    Rates are null when the table, or the group, holds one class only.
    """
    run = _roc_totals(df, label, score, by)
    sums = run.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    points = run.select(*by, "threshold", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))
    if by:
        # Null-safe, so that a null group keeps its points.
        of = sums.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_p", "_n")
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
        points = points.join(of, reduce(and_, same)).drop(*[f"_of_{c}" for c in by])
    else:
        total = sums.first()
        points = points.withColumns({c: F.lit(total[c]).cast("long") for c in ("_p", "_n")})
    if origin:
        zero = F.lit(0).cast("long")
        points = sums.select(*by, F.lit(float("inf")).alias("threshold"), zero.alias("tp"),
                             zero.alias("fp"), "_p", "_n").unionByName(points)

    def rate(count: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(count) / F.col(of))

    return points.select(*by, "threshold", "tp", "fp", rate("tp", "_p").alias("tpr"),
                         rate("fp", "_n").alias("fpr"))


def roc_auc(
    df: DataFrame, label: str = CHURN_LABEL, score: str = "ChurnProb", by: Sequence[str] = ()
) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half. Null for one class."""
    run = _roc_totals(df, label, score, by)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    sums = run.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(pos * (F.col("cum_neg").cast("double") - neg / 2.0)).alias("above"))
    # `above` counts the (positive, negative) pairs in the wrong order.
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return sums.select(*by, "positives", "negatives",
                       F.when(pairs > 0, 1.0 - F.col("above") / pairs).alias("auc"))


def regression_metrics(df: DataFrame, label: str = CLV_LABEL, pred: str = "PredCLV",
                       by: Sequence[str] = ()) -> DataFrame:
    """n, R2 and mean absolute error. The variance form keeps it to one pass."""
    error = F.col(label) - F.col(pred)
    known = df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull())
    sums = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("residual"),
        F.var_pop(label).alias("variance"), F.avg(F.abs(error)).alias("mae"))
    total = F.col("variance") * F.col("n")
    return sums.select(*by, "n", F.when(total > 0, 1.0 - F.col("residual") / total).alias("r2"),
                       "mae")


def actual_vs_pred(df: DataFrame) -> DataFrame:
    return df.select(ID, F.col(CLV_LABEL).alias("actual"), F.col("PredCLV").alias("predicted"))
