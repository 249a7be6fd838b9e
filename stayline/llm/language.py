"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes, contexts of 0 to `order` bytes, with
escape probabilities by the number of distinct symbols a context has seen (method C):
P(symbol | context) = n / (t + d), P(escape) = d / (t + d), down to 1/256 below order 0.
Statistics are frozen after training, so a text's code length in a language is a sum over its
bytes of a number that depends on the last `order` bytes and the byte. The language with the
shortest code wins; the score is its share of 2^-length.

Training is bounded by documents alone: at most `most_docs` a language (the smallest text hashes).
Every context-symbol string in them counts, and every label is a language. Spark counts the
strings; the counts, and nothing else, come to the driver and are broadcast. Languages are
independent of each other and are laid out in blocks, so a model's size goes with its strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 19
_LANGS = 16


def has_letter(text: str | None) -> bool:
    return text is not None and bool(_LETTER.search(text))


def gram_codes(data: np.ndarray, size: int) -> np.ndarray:
    """The `size`-byte strings that end at each position from size - 1 on, with a leading 1 byte."""
    n = len(data) - size + 1
    out = np.full(n, 1, np.uint64)
    for k in range(size):
        out <<= np.uint64(8)
        out |= data[k:k + n]
    return out


class Lookup:
    """Positions of 64-bit keys: one slot a key, the keys that collide in a sorted rest."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        slots = self._slots(keys)
        _, first = np.unique(slots, return_index=True)
        self.keys[slots[first]], self.at[slots[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more, self.more_at = keys[rest], rest.astype(np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's position, -1 for those not there; no key is 0."""
        slots = self._slots(keys)
        hit = self.keys[slots] == keys
        out = np.where(hit, self.at[slots], -1)
        if len(self.more) and not hit.all():
            miss = np.flatnonzero(~hit)
            near = np.minimum(np.searchsorted(self.more, keys[miss]), len(self.more) - 1)
            out[miss] = np.where(self.more[near] == keys[miss], self.more_at[near], -1)
        return out


@dataclass
class LanguageBlock:
    """For each gram size, the costs (bits) of known grams and of escaping from known contexts."""

    names: list[str]
    order: int
    grams: list[tuple[Lookup, np.ndarray]]  # by size - 1: positions, bits per language
    escapes: list[tuple[Lookup, np.ndarray]]  # by context length

    @classmethod
    def build(cls, names: list[str], order: int, counts: pd.DataFrame) -> LanguageBlock:
        """counts: size, code, lang (an index into names), n."""
        model = cls(names, order, [], [])
        for size in range(1, order + 2):
            own = counts[counts["size"] == size]
            codes, row = np.unique(own.code.to_numpy(np.int64).astype(np.uint64), return_inverse=True)
            seen = np.zeros((len(codes), len(names)))
            np.add.at(seen, (row, own.lang.to_numpy(int)), own.n.to_numpy(float))
            low = np.uint64(8)
            contexts, of = np.unique(codes >> low, return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(names))), np.zeros((len(contexts), len(names)))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                bits = np.log2((total + kinds)[of] / seen)
            if len(codes):
                below = model.bits(codes, size - 1)
                bits = np.where(seen > 0, bits, leave[of] + below)
            model.grams.append((Lookup(codes), bits.astype(np.float32)))
            model.escapes.append((Lookup(contexts), leave.astype(np.float32)))
        return model

    def bits(self, codes: np.ndarray, size: int) -> np.ndarray:
        """Code length of the last byte of each code, with contexts of up to size - 1 bytes."""
        out = np.zeros((len(codes), len(self.names)), np.float32)
        todo = np.arange(len(codes))
        for s in range(size, 0, -1):
            mask = np.uint64((1 << 8 * s) - 1)
            own = (codes[todo] & mask) | np.uint64(1 << 8 * s)
            lookup, bits = self.grams[s - 1]
            at = lookup.find(own)
            hit = at >= 0
            out[todo[hit]] += bits[at[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            lookup, leave = self.escapes[s - 1]
            at = lookup.find(own >> np.uint64(8))
            hit = at >= 0
            out[todo[hit]] += leave[at[hit]]
        out[todo] += 8
        return out


@dataclass
class LanguageModel:
    """All languages, in blocks of `_LANGS`."""

    names: list[str]
    order: int
    blocks: list[LanguageBlock]

    @classmethod
    def build(cls, names: list[str], order: int, counts: pd.DataFrame) -> LanguageModel:
        """counts: size, code, lang (an index into names), n."""
        model = cls(names, order, [])
        block = counts["lang"].to_numpy(int) // _LANGS
        for first in range(0, len(names), _LANGS):
            own = counts[block == first // _LANGS]
            model.blocks.append(LanguageBlock.build(
                names[first:first + _LANGS], order, own.assign(lang=own["lang"] - first)))
        return model

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; whole texts, worked through in blocks."""
        pad = b"\n" * self.order
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.names)))
        data = np.frombuffer(pad + pad.join(texts) if len(texts) else b"", np.uint8)
        owner = np.repeat(np.arange(len(texts)), sizes + self.order)
        owner[np.concatenate([[0], np.cumsum(sizes + self.order)[:-1]])[:, None] + np.arange(self.order)] = -1
        for start in range(0, len(owner), _BLOCK):
            part = data[max(0, start - self.order):start + _BLOCK]
            who = owner[start:start + _BLOCK]
            if start == 0:
                who = who[self.order:]
            codes = gram_codes(part, self.order + 1)
            real = who >= 0
            codes, who = codes[real], who[real]
            if not len(who):
                continue
            first, last = int(who[0]), int(who[-1])
            for at, block in zip(range(0, len(self.names), _LANGS), self.blocks, strict=True):
                bits = block.bits(codes, self.order + 1)
                for k in range(len(block.names)):
                    out[first:last + 1, at + k] += np.bincount(who - first, bits[:, k], last - first + 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(self.names) and has_letter(t) for t in texts], bool)
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        rows = np.flatnonzero(known)
        if len(rows):
            lengths = self.code_lengths([texts[i].encode() for i in rows])
            best = lengths.argmin(axis=1)
            share = np.exp2(np.maximum(lengths.min(axis=1, keepdims=True) - lengths, -1000)).sum(axis=1)
            langs[rows], scores[rows] = np.array(self.names, object)[best], 1 / share
        return langs.tolist(), scores


def _count_grams(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang.setdefault(lang, []).append(b"\n" * order + text.encode())
            for lang, texts in by_lang.items():
                for size in range(1, order + 2):
                    codes = [gram_codes(np.frombuffer(t, np.uint8)[order + 1 - size:], size) for t in texts]
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), size), pa.int64()),
                        pa.array(code.astype(np.int64)), pa.array(n, pa.int64()),
                    ], names=["lang", "size", "code", "n"])

    return run


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", order: int = 4,
    most_docs: int = 400,
) -> LanguageModel:
    """Learn from the rows that have a text and a language; without any, everything is `und`."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()) \
        .select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")) \
        .filter(F.length("text") > 0)
    mark = F.xxhash64("text").alias("mark")
    salted = Window.partitionBy("lang", F.pmod("mark", F.lit(64))).orderBy("mark")
    overall = Window.partitionBy("lang").orderBy("mark")
    first = rows.select("lang", mark).distinct() \
        .withColumn("at", F.row_number().over(salted)).filter(F.col("at") <= most_docs) \
        .withColumn("at", F.row_number().over(overall)).filter(F.col("at") <= most_docs).select("lang", "mark")
    # most_docs pairs of a label and a hash for each language: fewer than the strings that the driver takes.
    sample = rows.withColumn("mark", F.xxhash64("text")).join(F.broadcast(first), ["lang", "mark"], "left_semi")
    sample = sample.dropDuplicates(["lang", "mark"]).select("lang", "text")
    counts = sample.mapInArrow(_count_grams(order), "lang string, size long, code long, n long") \
        .groupBy("lang", "size", "code").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    names = sorted(pc.unique(found["lang"]).to_pylist())
    at = pc.index_in(found["lang"], pa.array(names, pa.string()))
    return LanguageModel.build(names, order, pd.DataFrame(
        {"lang": at.to_numpy(), **{c: found[c].to_numpy() for c in ("size", "code", "n")}}))


def predictor(docs: DataFrame, model: LanguageModel) -> Callable[[Column], Column]:
    """A column function from text to struct<lang_pred, score>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            found = [shared.value.predict(series.iloc[i:i + 256].tolist()) for i in range(0, len(series), 256)]
            yield pd.DataFrame({"lang_pred": [x for a, _ in found for x in a],
                                "score": [x for _, b in found for x in b]})

    return predict


def lettered() -> Callable[[Column], Column]:
    """A column function: whether a text has a letter, by the predictor's own rule."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([has_letter(t) for t in texts.tolist()], dtype=bool)

    return found


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred and score (0 to 1).

    A null text and one without a letter are `und` with score 0. Equal code lengths go to the
    first language by name. Repeated rows and null keys stay; an empty table gives an empty one.
    """
    found = predictor(docs, model)(F.col(text).cast("string"))
    return docs.select(F.col(key), found.alias("found")).select(key, "found.lang_pred", "found.score")
