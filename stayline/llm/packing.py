"""Packing documents into fixed windows: bounded-space best fit.

Each partition keeps at most `open_windows` windows open. A document gives whole windows while
it is at least a window long; the rest goes to the open window with the least room that still
holds it. When none does, the fullest is topped up from the piece's head and emitted. At the
end a partition's open windows are poured together, which leaves at most one that isn't full.
Those leftovers (under one window a partition) are merged in groups of `fan_in` partitions,
level by level, until one is left; that one is cut at powers of two, which need no padding.

The pieces are written once to the shared folder, since the leftovers depend on them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.byte_ids import encoder
from stayline.llm.common import kept, text_of

COLUMNS = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, part long"


@dataclass(frozen=True)
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:4 * n]),
                Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[4 * n:]))


class Packer:
    """Best fit over a bounded number of open windows; full ones come out of `add`."""

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.windows: dict[int, list[Piece]] = {}
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.made = 0

    def _put(self, at: int, piece: Piece) -> Iterator[list[Piece]]:
        room, window = self.rooms.pop(at)
        self.windows[window].append(piece)
        if room == len(piece):
            yield self.windows.pop(window)
        else:
            insort(self.rooms, (room - len(piece), window))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece) >= self.length:
            whole, piece = piece.cut(self.length)
            yield [whole]
        while len(piece):
            at = bisect_left(self.rooms, (len(piece), -1))
            if at < len(self.rooms):
                yield from self._put(at, piece)
                return
            if len(self.rooms) < self.most:
                self.made += 1
                self.windows[self.made] = [piece]
                insort(self.rooms, (self.length - len(piece), self.made))
                return
            head, piece = piece.cut(self.rooms[0][0])  # none fits: fill the fullest and emit it
            yield from self._put(0, head)

    def leftovers(self) -> list[Piece]:
        """The pieces of the open windows, the fullest window first."""
        return [p for _, w in self.rooms for p in self.windows[w]]


def pour(pieces: list[Piece], lengths: Iterator[int]) -> Iterator[list[Piece]]:
    """Sequences of the given lengths, in order; the last may be shorter."""
    now, room = [], next(lengths)
    for piece in pieces:
        while len(piece):
            head, piece = piece.cut(min(room, len(piece)))
            now.append(head)
            room -= len(head)
            if not room:
                yield now
                now, room = [], next(lengths)
    if now:
        yield now


def forever(length: int) -> Iterator[int]:
    while True:
        yield length


def powers(total: int) -> Iterator[int]:
    """The powers of two that add up to a total, largest first, then 1 for ever."""
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            yield 1 << bit
    yield from forever(1)


def _rows(sequence: list[Piece], number: int, part: int) -> list[tuple]:
    out, at = [], 0
    for p in sequence:
        out.append((p.doc_id, p.start, len(p), p.doc_tokens, number, at, p.ids, part))
        at += len(p)
    return out


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, open_windows: int = 64,
    fan_in: int = 256, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (bytes).

    A null text is empty and gives the end id alone; a null key stays null; repeated rows are
    packed one by one; a text longer than a window is cut; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    tail = np.array([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder, packer, number = encoder(tokenizer), Packer(length, open_windows), part << 36
        for batch in batches:
            ids_of, out = batch.column(0).to_pylist(), []
            for doc_id, ids in zip(ids_of, coder.encode(batch.column(1).to_pylist()), strict=True):
                whole = Piece(doc_id, 0, len(ids) // 4 + 1, ids + tail)
                for sequence in packer.add(whole):
                    out += _rows(sequence, number, -1)
                    number += 1
            if out:
                yield batch_of(out)
        out = []
        for sequence in pour(packer.leftovers(), forever(length)):
            full = sum(map(len, sequence)) == length
            out += _rows(sequence, number, -1 if full else part)
            number += 1
        if out:
            yield batch_of(out)

    def merger(level: int, last: bool):
        def merge(group: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            pieces = [Piece(*x) for x in zip(
                *(rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True)]
            meet = group[0].as_py()
            number, out = (level << 58) + (meet << 36), []
            sequences = list(pour(pieces, forever(length)))
            if last:  # what doesn't fill a window ends at powers of two
                rest = sequences.pop()
                sequences += pour(rest, powers(sum(map(len, rest))))
            for sequence in sequences:
                full = last or sum(map(len, sequence)) == length
                out += _rows(sequence, number, -1 if full else meet)
                number += 1
            return pa.Table.from_batches([batch_of(out)])

        return merge

    first = kept(rows.mapInArrow(run, SCHEMA))
    done = [first.filter("part < 0")]
    left = first.filter("part >= 0")
    most = left.agg(F.max("part")).first()[0]
    level, last = 1, most is None
    while not last:
        last = most < fan_in

        merge = merger(level, last)
        merged = left.withColumn("meet", F.floor(F.col("part") / fan_in).cast("long")) \
            .groupBy("meet").applyInArrow(merge, SCHEMA)
        if last:
            done.append(merged)
        else:
            merged = kept(merged)
            done.append(merged.filter("part < 0"))
            left = merged.filter("part >= 0")
            most //= fan_in
            level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*COLUMNS)
