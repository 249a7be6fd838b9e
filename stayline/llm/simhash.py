"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a 23-bit word.
The perfect Golay code has a codeword within 3 bits of every word, so the codewords within 4 bits
of a word (5 on average) include the nearest codeword of every word one bit away. Two
fingerprints that differ in at most 2 bits have, for one i of the three, segment i equal and at
most one error in segment i + 1 (pigeonhole); they share the key (i, segment i, codeword) for
some codeword. Distinct fingerprints are joined on those keys and checked bit by bit.

A bucket yields the edges of a spanning forest of its checked links, never all pairs. A bucket of
more than `most_in_bucket` fingerprints is not compared pair by pair: its members are joined on
their bits outside segment i with two of them masked, which is exact for distances up to 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import kept, text_of
from stayline.llm.components import connected_components

#: Shift and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The binary Golay code's generator polynomial: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
RADIUS = 4


class GolayCode:
    """For a 23-bit word, the 12-bit indices of all codewords within RADIUS bits."""

    def __init__(self):
        low, high = np.arange(1 << 12), np.arange(1 << 11) << 12
        self.low, self.high = self._remainder(low), self._remainder(high)
        errors = [0]
        layer = [0]
        for _ in range(RADIUS):
            layer = [e | 1 << b for e in layer for b in range(e.bit_length(), 23)]
            errors += layer
        errors = np.array(errors, np.int64)
        of = self._remainder(errors)
        order = np.argsort(of, kind="stable")
        self.errors = errors[order]
        self.first = np.searchsorted(of[order], np.arange((1 << 11) + 1))

    @staticmethod
    def _remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
        return words

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs: position in `words`, index of a codeword near that word."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        first, last = self.first[syndrome], self.first[syndrome + 1]
        at = np.repeat(np.arange(len(words)), last - first)
        step = np.arange(len(at)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
        return at, (words[at] ^ self.errors[first[at] + step]) >> 11


def simhash(texts: list[str], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is in over half the shingles' hashes."""
    out, digest = np.zeros(len(texts), np.uint64), xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.encode().lower().split()  # bytes: only A-Z fall, only ASCII spaces split
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes = [digest(joined, seed)]
        else:
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            pairs = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)
            hashes = [digest(joined[a:b], seed) for a, b in pairs]
        raw, total = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
        for at in range(0, len(raw), 60_000):
            total += np.unpackbits(raw[at:at + 60_000], axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out[i] = np.packbits(2 * total > len(raw), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Per row: doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = simhash(batch.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _keys(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = GolayCode()
        for batch in batches:
            words = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [((words >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
            for i in range(3):
                at, index = code.near(parts[(i + 1) % 3])
                key = (np.int64(i) << np.int64(34)) | (parts[i][at] << 12) | index
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(words[at].view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _forest(members: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Edges that connect what is within `distance` bits: at most one fewer than the members."""
    left = np.arange(len(members))
    while len(left):  # breadth-first from the first one not reached yet
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(members[front][:, None] ^ members[left][None, :]) <= distance
            reached = near.any(axis=0)
            for a, b in zip(front[near.argmax(axis=0)[reached]].tolist(), left[reached].tolist(), strict=True):
                yield a, b
            front, left = left[reached], left[~reached]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, links within each key; the last key of a batch is carried over."""
    carry_key, carry_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def work(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        two = first[size == 2]  # most shared keys have two members
        close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
        u, v = [fp[two[close]]], [fp[two[close] + 1]]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            group = fp[at:at + n]
            pairs = np.array(list(_forest(group, distance)), np.int64).reshape(-1, 2)
            u.append(group[pairs[:, 0]])
            v.append(group[pairs[:, 1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    for batch in batches:
        key = np.concatenate([carry_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([carry_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = np.searchsorted(key, key[-1]) if len(key) else 0
        yield from work(key[:cut], fp[:cut])
        carry_key, carry_fp = key[cut:], fp[cut:]
    yield from work(carry_key, carry_fp)


def _masked_links(crowded: DataFrame) -> DataFrame:
    """Links in crowded keys: members that agree outside two masked bits join the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            words = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(3):
                own, key = words[keys >> 34 == i], keys[keys >> 34 == i]
                if not len(own):
                    continue
                shift, width = SEGMENTS[i]
                free = [b for b in range(64) if not shift <= b < shift + width]
                for n, a in enumerate(free):
                    for b in free[n + 1:]:
                        mask = ~((one << np.uint64(a)) | (one << np.uint64(b)))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(key), pa.array(np.full(len(own), a * 64 + b, np.int64)),
                            pa.array((own & mask).view(np.int64)), pa.array(own.view(np.int64)),
                        ], names=["key", "mask", "rest", "fp"])

    rows = crowded.mapInArrow(run, "key long, mask long, rest long, fp long")
    by = ["key", "mask", "rest"]
    least = rows.groupBy(*by).agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(least, by).filter("fp != u").select("u", F.col("fp").alias("v"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2,
    most_in_bucket: int = 4096,
) -> DataFrame:
    """Per row: doc_id, fp and component_id, the smallest doc_id that links of at most `distance`
    bits (2 or fewer) reach.

    A null or blank text has fingerprint zero and links like any other. Equal texts, and
    repeated rows, share fingerprint and component. A null doc_id never names a component
    unless all of its rows have null ids. An empty table gives an empty table.
    """
    if not 0 <= distance <= 2:
        raise ValueError("Golay keys find distances of 0, 1 and 2")
    rows = kept(fingerprints(docs, key, text, shingle))
    fps = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    keys = kept(_keys(fps))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keys.join(sizes, "key")
    calm = shared.filter(F.col("n") <= most_in_bucket).select("key", "fp")
    edges = calm.repartition("key").sortWithinPartitions("key") \
        .mapInArrow(lambda b: _links(b, distance), "u long, v long")
    crowded = kept(shared.filter(F.col("n") > most_in_bucket).select("key", "fp"))
    if not crowded.isEmpty():
        far = _masked_links(crowded)
        edges = edges.unionByName(far.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
    roots = connected_components(edges.distinct())
    of_fp = fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    found = of_fp.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")
