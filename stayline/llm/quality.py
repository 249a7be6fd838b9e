"""A text quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of statistics (sizes, shares of kinds of characters, repetition,
compressibility), transformed so that a normal law is a fair description of each class, and rounded
to steps of 2^-16. A class has a mean and a covariance. The covariance is shrunk twice: towards the
covariance that all classes share, and towards a multiple of the identity (in units of the overall
deviations). Its Cholesky factor is computed once, at the fit; a score is the difference of two
Mahalanobis log densities, taken with the inverse factors.

Sums of rounded statistics are whole numbers and are added as such, so a fit doesn't depend on the order
or the partitions of the rows. Every labelled row counts. What reaches the driver is one row per class
and pair of statistics, whatever the size of the table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import kept

STEP = 1 << 16
#: Names of the statistics, in the order of the vector.
STATISTICS = (
    "bytes", "words", "distinct_words", "upper", "high", "digits", "marks", "lines", "word_length",
    "word_spread", "same_as_before", "compressed", "doubled", "stops")
_SLICE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
_ROWS = 4096


def _slices(raw: bytes) -> Iterator[bytes]:
    """Parts of a text, cut behind white space, of `_SLICE` bytes or up to the next one."""
    at = 0
    while at < len(raw):
        end = _SPACE.search(raw, at + _SLICE - 1)
        yield raw[at:end.end() if end else len(raw)]
        at = end.end() if end else len(raw)


def statistics(text: str | None) -> np.ndarray:
    """The transformed vector of a whole text; null counts as empty."""
    raw = (text or "").encode()
    size, press, packed = len(raw), zlib.compressobj(1), 0
    kinds, doubled, last = np.zeros(256, np.int64), 0, b""
    words, letters_in_words, squares, same, distinct = 0, 0, 0, 0, set()
    for part in _slices(raw):
        packed += len(press.compress(part))
        data = np.frombuffer(part, np.uint8)
        kinds += np.bincount(data, minlength=256)
        doubled += np.count_nonzero(data[1:] == data[:-1])
        own = part.split()
        if own:
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            words, letters_in_words, squares = words + len(own), letters_in_words + int(lengths.sum()), squares + int((lengths**2).sum())
            same += sum(map(bytes.__eq__, own, own[1:])) + (own[0] == last)
            distinct.update(own)
            last = own[-1]
    packed += len(press.flush())
    upper, lower, high, digits = (int(kinds[a:b].sum()) for a, b in ((65, 91), (97, 123), (128, 256), (48, 58)))
    letters = upper + lower + high
    marks = size - letters - digits - int(kinds[32] + kinds[9:14].sum())
    mean = letters_in_words / max(words, 1)
    spread = max(squares / max(words, 1) - mean**2, 0) ** 0.5
    share = lambda x, of: np.log((x + 0.5) / (of + 1))
    return np.array([
        np.log1p(size), np.log1p(words), np.log1p(len(distinct) / max(words, 1)), share(upper, letters),
        share(high, letters), share(digits, size), share(marks, size), share(kinds[10], size), np.log(mean + 0.5),
        np.log(spread + 0.5), share(same, words), np.log((packed + 8) / (size + 16)), share(doubled, size),
        share(kinds[46], size)])


def with_statistics(docs: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
    """The columns `keep`, by name, and `stats`: whole steps of 2^-16, one long a statistic."""

    @F.pandas_udf("array<long>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([np.rint(statistics(t) * STEP).astype(np.int64) for t in series.tolist()], dtype=object)

    return docs.select(*[c.alias(n) for n, c in keep.items()], found(F.col(text).cast("string")).alias("stats"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, stats) to whole sums: counts at (-1, -1), sums at (i, -1), products at (i, j), j <= i."""
    size = len(STATISTICS)
    low = np.tril_indices(size)
    first = np.concatenate([[-1], np.arange(size), low[0]]).astype(np.int32)
    second = np.concatenate([[-1], np.full(size, -1), low[1]]).astype(np.int32)
    for batch in batches:
        labels, stats = batch.column(0).to_numpy(), _matrix(batch.column(1))
        for label in np.unique(labels):
            own = stats[labels == label]
            for at in range(0, len(own), _ROWS):  # so that a sum of products stays within 64 bits
                x = own[at:at + _ROWS]
                value = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[low]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), label, np.int32)), pa.array(first), pa.array(second), pa.array(value)],
                    names=["label", "i", "j", "value"])


@dataclass
class QualityModel:
    """Class 0 and class 1: share, mean, inverse Cholesky factor and half log determinant, for
    statistics in units of the overall deviations."""

    centre: np.ndarray
    scale: np.ndarray
    shares: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    half_logs: np.ndarray

    @classmethod
    def build(cls, sums: list[tuple[int, int, int, int]], pooled: float, ridge: float) -> QualityModel:
        """sums: (label, i, j, value) as exact integers, in steps."""
        p = len(STATISTICS)
        count, total, square = [0, 0], np.zeros((2, p)), np.zeros((2, p, p))
        for label, i, j, value in sums:
            if i < 0:
                count[label] = int(value)
            elif j < 0:
                total[label, i] = int(value) / STEP
            else:
                square[label, i, j] = square[label, j, i] = int(value) / STEP**2
        n = np.array(count, float)
        every = max(n.sum(), 1.0)
        centre = total.sum(axis=0) / every
        spread = np.sqrt(np.maximum(np.diag(square.sum(axis=0)) / every - centre**2, 0))
        scale = np.where(spread > 1e-6, spread, 1.0)
        raw = total / np.maximum(n, 1)[:, None]
        within = np.stack([
            (square[k] / max(n[k], 1) - np.outer(raw[k], raw[k])) / np.outer(scale, scale) for k in (0, 1)])
        shared = (within * (n / every)[:, None, None]).sum(axis=0)
        whiten, half = [], []
        for k in (0, 1):
            own = (1 - pooled) * within[k] + pooled * shared
            own = (1 - ridge) * own + ridge * max(np.trace(own) / p, 1e-3) * np.eye(p)
            factor = np.linalg.cholesky(own + 1e-9 * np.eye(p))
            whiten.append(np.linalg.solve(factor, np.eye(p)))
            half.append(np.log(np.diag(factor)).sum())
        return cls(centre, scale, n / every, (raw - centre) / scale, np.stack(whiten), np.array(half))

    def odds(self, stats: np.ndarray) -> np.ndarray:
        """Log odds of label 1, a row of `stats` (in steps) each."""
        x = (stats / STEP - self.centre) / self.scale
        lean = [((x - m) @ w.T) ** 2 for m, w in zip(self.means, self.whiten, strict=True)]
        density = [-0.5 * d.sum(axis=1) - h for d, h in zip(lean, self.half_logs, strict=True)]
        return density[1] - density[0] + np.log(self.shares[1]) - np.log(self.shares[0])

    def score(self, stats: np.ndarray) -> np.ndarray:
        """From 0 to 1; log odds are divided by the number of statistics, so that scores don't saturate."""
        if not self.shares.all():  # a class without rows has no density: the share of label 1 is all that is known
            return np.full(len(stats), self.shares[1] if self.shares.any() else 0.5)
        odds = np.clip(self.odds(stats) / len(STATISTICS), -700, 700)
        return 1 / (1 + np.exp(-odds))


def fit(labelled: DataFrame, pooled: float = 0.5, ridge: float = 0.02) -> QualityModel:
    """From rows (label, stats), label 0 or 1: every row counts; rows with a null label don't."""
    rows = labelled.filter("label is not null").select(F.col("label").cast("int").alias("label"), "stats")
    sums = rows.mapInArrow(_sums, "label int, i int, j int, value long") \
        .groupBy("label", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return QualityModel.build([tuple(r) for r in sums.collect()], pooled, ridge)


def scorer(docs: DataFrame, model: QualityModel) -> Callable[[Column], Column]:
    """A column function from `stats` to a score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two matrices of a fixed size

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(stats.to_numpy())) if len(stats) else [], dtype=float)

    return score


def classify(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
    label: str = "quality", pooled: float = 0.5, ridge: float = 0.02,
) -> DataFrame:
    """Per row of `docs`: key, learned (whether `learn`, a condition on the key, holds) and score.

    Learned from rows of `docs` for which `learn` holds and `labels` has label 0 or 1 under their key;
    a key labelled both ways counts as one row of either class, a label given twice counts once. A null key has no
    label. A null text is empty, and empty texts are scored as any other. Where a class has no
    rows, the score is the share of label 1 (0.5 without any label). Repeated rows get equal scores; an empty
    table gives none. Each text is read once; its statistics are stored for the fit and the scores.
    """
    chosen = F.coalesce(learn, F.lit(False))
    rows = kept(with_statistics(docs, text, {"id": F.col(key), "learned": chosen}))
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")) \
        .filter("id is not null and label in (0, 1)").distinct()
    both = rows.filter("learned").join(known, "id").select("label", "stats")
    score = scorer(docs, fit(both, pooled, ridge))
    return rows.select(F.col("id").alias(key), "learned", score(F.col("stats")).alias("score"))
