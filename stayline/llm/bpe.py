"""Byte-pair encoding and decoding from a tokenizer file's merges.

A word's symbols form a doubly linked list. A priority queue holds each adjacent pair that has a
merge, by merge rank and then position. A popped entry is stale, and skipped, when its pair
has changed since; otherwise the right symbol joins the left one and the two new
neighbour pairs enter the queue. Decoding concatenates vocabulary strings, with the spaces
that the file's missing decoder stands for.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import text_of

#: Entries a process keeps; a full table is emptied. Longer units aren't kept.
MOST_KEPT, LONGEST_KEPT = 400_000, 48


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges (pair -> rank, merged symbol) until none fits, lowest rank first, then leftmost."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    get = merges.get
    queue = [(m[0], i, m[1]) for i in range(n - 1) if (m := get((symbols[i], symbols[i + 1])))]
    if not queue:
        return symbols
    heapify(queue)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while queue:
        _, at, merged = heappop(queue)
        right = after[at]
        if symbols[at] < 0 or right >= n:
            continue
        now = get((symbols[at], symbols[right]))
        if now is None or now[1] != merged:
            continue  # stale
        symbols[at], symbols[right] = merged, -1
        beyond = after[at] = after[right]
        if beyond < n:
            before[beyond] = at
            if m := get((merged, symbols[beyond])):
                heappush(queue, (m[0], at, m[1]))
        left = before[at]
        if left >= 0 and (m := get((symbols[left], merged))):
            heappush(queue, (m[0], left, m[1]))
    return [s for s in symbols if s >= 0]


class WordBpe:
    """Lower-casing byte-level BPE with an end-of-word suffix, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.end = model["end_of_word_suffix"] or ""
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.byte = byte_characters()
        self.known_words: dict[str, list[int]] = {}
        self.known_units: dict[str, tuple[bytes, str]] = {}

    def encode_word(self, word: str) -> list[int]:
        shown = [self.byte[b] for b in word.encode()]
        shown[-1] += self.end
        return merge_symbols([self.vocab[c] for c in shown if c in self.vocab], self.merges)

    def _plain(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        out = []
        for word in self.words.findall(text):
            ids = self.known_words.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(self.known_words) >= MOST_KEPT:
                    self.known_words.clear()
                if len(word) <= LONGEST_KEPT:
                    self.known_words[word] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        out = []
        for part in self.around.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids if i in self.strings])

    def _unit(self, unit: str) -> tuple[bytes, str]:
        found = self.known_units.get(unit)
        if found is None:
            ids = self.encode(unit)
            found = np.array(ids, "<u4").tobytes(), self.decode(ids)
            if len(self.known_units) >= MOST_KEPT:
                self.known_units.clear()
            if len(unit) <= LONGEST_KEPT:
                self.known_units[unit] = found
        return found

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Ids (little-endian unsigned 32-bit) and their decoded text.

        No word and no special string spans a space, and no normalization does, so the
        text is worked through a space-separated unit at a time.
        """
        found = [self._unit(u) for u in text.split(" ") if u]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids (bytes, little-endian unsigned 32-bit) and decoded text.

    A null or empty text has no ids and decodes to the empty text. Rows are kept one to one,
    repeated rows and null keys included; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                both = [model.round_trip(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(i) // 4 for i, _ in both], pa.int64()),
                    pa.array([i for i, _ in both], pa.binary()),
                    pa.array([d for _, d in both], pa.string()),
                ], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
