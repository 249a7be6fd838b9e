"""Removal of long repeated byte strings, by column-wise multi-document construction.

Routing. Every 400-byte window is assigned to its minimizer: the leftmost of its 32-byte
strings with the least hash. Consecutive windows with one anchor form a segment (at most 767
bytes). Equal windows have the same minimizer at the same place, so they meet under the
minimizer's hash, aligned at the anchor. A minimizer seen once holds no repeat.

Comparison. Byte-equal segments are represented by one of them and their number. All representatives of
a minimizer that was seen twice are aligned at their anchors. From the last column to the first, each
round inserts one symbol per segment into the collection's Burrows-Wheeler transform: the round reads
suffix order, common prefixes and transform symbols from one sequential file, sorts stably by
(group, symbol), takes the common prefix of two neighbours as one more than the least common prefix between
them in the old order (nothing if their symbols differ), and writes order, common prefixes and the next
column's transform symbols to the other file. A window repeats where the common prefix with a
neighbour reaches 400, or where its segment stands for several and has 400 bytes left.

A minimizer with more than `most_in_group` distinct segments is not gathered: its windows are counted
one by one by 128-bit hash, which is exact for the same reason that segment hashes are.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from stayline.llm.common import fresh_names, kept, shared_folder

WINDOW, GRAM = 400, 32
_SLICE = 1 << 22
#: Buckets of stored rows: of this size, no fewer than shuffle partitions, no more than Spark takes by default.
_BUCKET_BYTES, _MOST_BUCKETS = 256 << 20, 100_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
#: A segment: its minimizer's hash and its own; two segments are mistaken only where both agree.
SEGMENT = ["m", "h"]
_ROWS = "m long, h long, rid long, start int, anchor short, windows short"


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as an integer."""
    out = data.astype(np.uint64)
    for step in (1, 2, 4):
        out = out[:len(out) - step] | (out[step:] << np.uint64(8 * step))
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each position on."""
    word = _words(data)
    n = len(data) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k, mix in enumerate(_MIX):
        out ^= word[8 * k:8 * k + n]
        out *= mix
        out ^= out >> np.uint64(29)
    return out * _MIX[0]


def segments(data: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Arrays first, last (window starts first..last-1), anchor and the anchor's hash."""
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # leftmost of equals
    span, want = 1, window - GRAM + 1
    while span < want:  # minimum over `want` positions, by doubling
        step = min(span, want - span)
        least = np.minimum(least[:len(least) - step], least[step:])
        span += step
    anchor = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return first, np.append(first[1:], len(anchor)), anchor[first], hashes[anchor[first]]


def _segment_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for rid, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = _unzip(packed)
            for at in range(0, max(1, len(raw) - window + 1), _SLICE):
                piece = raw[at:at + _SLICE + window - 1]
                first, last, anchor, m = segments(np.frombuffer(piece, np.uint8), window)
                if not len(first):
                    continue
                ends = (last + window - 1).tolist()
                out[0].append(m.view(np.int64))
                out[1].append(np.fromiter(
                    (digest(piece[a:b]) for a, b in zip(first.tolist(), ends, strict=True)), np.uint64, len(ends)).view(np.int64))
                out[2].append(np.full(len(first), rid, np.int64))
                out[3].append((first + at).astype(np.int32))
                out[4].append((anchor - first).astype(np.int16))
                out[5].append((last - first).astype(np.int16))
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in out], names=[*SEGMENT, "rid", "start", "anchor", "windows"])


class _Round:
    """What one round leaves for the next, in a sequential file: for each suffix, in suffix order, its
    segment, its common prefix with the suffix before it, and the symbol before it (the transform)."""

    def __init__(self) -> None:
        self.file, self.size = tempfile.TemporaryFile(), 0

    def write(self, order: np.ndarray, common: np.ndarray, symbol: np.ndarray) -> None:
        self.file.seek(0)
        for part in (order.astype(np.int32), common.astype(np.int32), symbol):
            self.file.write(part)
        self.size = len(order)

    def read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.file.seek(0)
        order = np.fromfile(self.file, np.int32, self.size)
        return order, np.fromfile(self.file, np.int32, self.size), np.fromfile(self.file, np.uint8, self.size)


def column_repeats(
    group: np.ndarray, anchor: np.ndarray, windows: np.ndarray, copies: np.ndarray, texts: list[bytes],
    window: int = WINDOW,
) -> np.ndarray:
    """For segments (group number, anchor's offset, window count, how many it stands for, bytes): which
    windows repeat. Rows of the result are segments, columns their window starts."""
    d, left = len(texts), int(anchor.max())
    size = np.array([len(t) for t in texts])
    shift = left - anchor  # column of a segment's first byte
    width = int((shift + size).max())
    repeats = np.zeros((width, d), bool)
    opens, closes, several = shift + size - 1, shift, copies > 1
    with tempfile.TemporaryFile() as symbols:
        block = np.zeros((d, width), np.uint8)
        for i, t in enumerate(texts):
            block[i, shift[i]:shift[i] + size[i]] = np.frombuffer(t, np.uint8)
        np.ascontiguousarray(block.T).tofile(symbols)
        del block

        def column_of(at: int) -> np.ndarray:
            symbols.seek(at * d)
            return np.fromfile(symbols, np.uint8, d)

        entering = np.argsort(-opens, kind="stable")
        entered = 0
        old, new = _Round(), _Round()
        for column in range(width - 1, -1, -1):
            order, common, before = old.read()
            upto = entered
            while upto < d and opens[entering[upto]] >= column:
                upto += 1
            if upto > entered:  # empty suffixes come first
                more = entering[entered:upto].astype(np.int32)
                order, common = np.concatenate([more, order]), np.concatenate([np.zeros(len(more), np.int32), common])
                before = np.concatenate([column_of(column)[more], before])
                entered = upto
            if len(common):
                common[0] = 0
            key = (group[order] << 8) | before
            move = np.argsort(key, kind="stable")
            ordered = key[move]
            same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
            shared = np.zeros(len(order), np.int32)
            at = np.flatnonzero(same)
            if len(at):
                low, high = move[at - 1] + 1, move[at] + 1
                near = high - low == 1
                found = common[low]
                if not near.all():
                    far = np.flatnonzero(~near)
                    pairs = np.stack([low[far], high[far]], axis=1).ravel()
                    found[far] = np.minimum.reduceat(np.append(common, 0), pairs)[::2]
                shared[at] = found + 1
            order, common = order[move], shared
            hit = (common >= window) | (several[order] & (opens[order] - column + 1 >= window))
            hit[:-1] |= common[1:] >= window
            repeats[column, order[hit]] = True
            stay = closes[order] < column
            if not stay.all():
                # Who leaves hands its common prefix on to the next one that stays.
                rest = np.flatnonzero(stay)
                if len(rest):
                    common = np.minimum.reduceat(common[:rest[-1] + 1], np.concatenate([[0], rest[:-1] + 1]))
                order, common = order[rest], common[:len(rest)]
            new.write(order, common, column_of(column - 1)[order] if column else np.zeros(0, np.uint8))
            old, new = new, old
        old.file.close()
        new.file.close()
    out = np.zeros((d, int(windows.max())), bool)
    for i, (s, w) in enumerate(zip(shift.tolist(), windows.tolist(), strict=True)):
        out[i, :w] = repeats[s:s + w, i]
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and past-the-last column of each run of True."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


def _compare(batches: Iterator[pa.RecordBatch], window: int, budget: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Segments sorted by m, in batches of whole minimizers, to runs of repeated window starts."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(rows).combine_chunks()
        m, h, copies, anchor, windows = (both.column(k).to_numpy().astype(np.int64) for k in range(5))
        group = np.cumsum(np.concatenate([[False], m[1:] != m[:-1]])).astype(np.int64)
        row, first, last = _runs(column_repeats(group, anchor, windows, copies, both.column(5).to_pylist(), window))
        yield pa.RecordBatch.from_arrays(
            [pa.array(m[row]), pa.array(h[row]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
            names=[*SEGMENT, "first", "last"])

    for batch in batches:
        m = batch.column(0).to_numpy()
        bytes_to = np.cumsum(np.append(0, pc.binary_length(batch.column(5)).to_numpy()))
        heads = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))  # first rows of minimizers
        at = 0
        for head in heads.tolist():
            goes_on = head == 0 and held and held[-1].column(0)[-1].as_py() == m[0]
            if size + bytes_to[head] - bytes_to[at] > budget and not goes_on and (held or head > at):
                yield from work([*held, batch.slice(at, head - at)] if head > at else held)
                held, size, at = [], 0, head
        if batch.num_rows > at:
            held.append(batch.slice(at))
            size += int(bytes_to[-1] - bytes_to[at])
    if held:
        yield from work(held)


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of segments, each with its 128-bit hash and how many times its segment occurs."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for m, h, copies, _, windows, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marks = b"".join([digest(text[k:k + window]) for k in range(windows)])
            mark = np.frombuffer(marks, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                *(pa.array(np.full(windows, x, np.int64)) for x in (m, h, copies)), pa.array(np.arange(windows, dtype=np.int32)),
                pa.array(mark[:, 0].copy()), pa.array(mark[:, 1].copy()),
            ], names=[*SEGMENT, "copies", "first", "w1", "w2"])


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column, a text, as compressed UTF-8; null stays null."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [None if t is None else press.compress(t.encode()) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:]], names=batch.schema.names)


def _unzip(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def _segment_bytes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (packed text, its wanted segments) to one row a segment with its bytes."""
    for batch in batches:
        for packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = _unzip(packed)
            out = {c: [w[c] for w in wanted] for c in (*SEGMENT, "copies", "kinds", "anchor", "windows")}
            out["bytes"] = [raw[w["start"]:w["start"] + w["windows"] + window - 1] for w in wanted]
            yield pa.RecordBatch.from_pydict(out, schema=_BYTES)


_BYTES = pa.schema([(c, pa.int64()) for c in (*SEGMENT, "copies", "kinds")]
                   + [("anchor", pa.int16()), ("windows", pa.int16()), ("bytes", pa.binary())])


def numbered(docs: DataFrame, text: str, rid: str, packed: str) -> DataFrame:
    """The rows with a number and their text compressed, stored in buckets of the number.

    Another job may split a scan in another way, which would number its rows anew; and every later join on
    the number finds the texts in place, so they are exchanged once.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(text).cast("string").alias(packed), F.monotonically_increasing_id().alias(rid), *own)
    schema = StructType([StructField(packed, BinaryType()), *rows.schema.fields[1:]])
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # as Spark estimates it
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // _BUCKET_BYTES), _MOST_BUCKETS)
    name, place = f"stay_{uuid.uuid4().hex}", f"{shared_folder(spark)}/rows"
    rows.mapInArrow(_zip, schema).repartition(parts, rid).write.option("path", place).option("compression", "zstd") \
        .bucketBy(parts, rid).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay, and the plan knows their buckets
    return found


def repeated_spans(rows: DataFrame, window: int = WINDOW, most_in_group: int = 20_000) -> DataFrame:
    """From stored rows (rid, zip) with unique rids: rid and `spans`, its array of (start, end) to remove."""
    found = kept(rows.select("rid", "zip").mapInArrow(lambda b: _segment_rows(b, window), _ROWS))
    distinct = found.groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "start", "anchor", "windows")).alias("one"))
    shared = distinct.groupBy("m").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all")) \
        .filter("all > 1").select("m", "kinds")
    live = kept(distinct.join(shared, "m").select(*SEGMENT, "copies", "kinds", "one.*"))
    wanted = live.groupBy("rid").agg(
        F.collect_list(F.struct(*SEGMENT, "copies", "kinds", "start", "anchor", "windows")).alias("wanted"))
    contested = rows.select("rid", "zip").join(wanted, "rid").select("zip", "wanted").mapInArrow(
        lambda b: _segment_bytes(b, window),
        "m long, h long, copies long, kinds long, anchor short, windows short, bytes binary")
    columns = [*SEGMENT, "copies", "anchor", "windows", "bytes"]
    calm = contested.filter(F.col("kinds") <= most_in_group).select(columns)
    spans = calm.repartition("m").sortWithinPartitions("m").mapInArrow(
        lambda b: _compare(b, window), "m long, h long, first int, last int")
    if not live.filter(F.col("kinds") > most_in_group).isEmpty():
        crowded = contested.filter(F.col("kinds") > most_in_group).select(columns)
        single = kept(crowded.mapInArrow(
            lambda b: _window_rows(b, window), "m long, h long, copies long, first int, w1 long, w2 long"))
        twice = single.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).filter("n > 1")
        spans = spans.unionByName(single.join(twice, ["w1", "w2"]).select(
            *SEGMENT, "first", (F.col("first") + 1).alias("last")))
    return found.join(spans, SEGMENT).groupBy("rid").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("first")).alias("start"),
        (F.col("start") + F.col("last") + (window - 1)).alias("end"))).alias("spans"))


def _whole_words(raw: bytes, start: int, end: int) -> tuple[int, int, int]:
    """The part of a run from its first whole word to its last, and how many words those are."""
    space = b" \t\n\x0b\x0c\r"
    if start and raw[start - 1:start] not in space and start < end:
        while start < end and raw[start:start + 1] not in space:
            start += 1
    if end < len(raw) and raw[end:end + 1] not in space:
        while end > start and raw[end - 1:end] not in space:
            end -= 1
    while 0 < start < end and raw[start:start + 1] in space:  # stays between what is left
        start += 1
    return start, end, len(raw[start:end].split())


def _cut(raw: bytes, spans: list[dict] | None, least_words: int) -> tuple[bytes, int]:
    """What is left, and how many maximal runs went."""
    if not spans:
        return raw, 0
    both = np.array([(s["start"], s["end"]) for s in spans], np.int64)
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    opens = np.concatenate([[True], both[1:, 0] > reach[:-1]])
    starts = both[opens, 0].tolist()
    ends = reach[np.append(np.flatnonzero(opens)[1:] - 1, len(reach) - 1)].tolist()
    if least_words:
        runs = [_whole_words(raw, a, b) for a, b in zip(starts, ends, strict=True)]
        runs = [r for r in runs if r[2] >= least_words]
        starts, ends = [r[0] for r in runs], [r[1] for r in runs]
    return b"".join([raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)]), len(starts)


def remove_repeats(
    docs: DataFrame, text: str = "text", window: int = WINDOW, most_in_group: int = 20_000,
    into: str = "found", least_words: int = 0,
) -> DataFrame:
    """All columns of `docs`, and a struct `into` of n_bytes, n_removed, n_spans, `kept` (the bytes
    left) and `kept_text` (the same as text, without characters that a cut has parted).

    Bytes covered by a `window`-byte string that also starts elsewhere, in the same text or another,
    are removed. With `least_words`, a run of such bytes is cut back to whole words and removed only if it has so
    many of them. A null text is empty; texts shorter than the window stay whole; a repeated row
    repeats its text; an empty table gives an empty one. `docs` is evaluated once: its rows are
    numbered and stored, and every later pass reads the stored numbers. A column of `docs` that is
    named like `into` is replaced; other names are free.
    """
    if not GRAM <= window <= 1 << 14:
        raise ValueError(f"windows have {GRAM} to {1 << 14} bytes")
    own = [c for c in docs.columns if c not in (into, text)]
    rid, packed, cuts = fresh_names(docs.columns, "rid", "zip", "spans")
    rows = numbered(docs.select(text, *own), text, rid, packed)
    spans = repeated_spans(rows.select(F.col(rid).alias("rid"), F.col(packed).alias("zip")), window, most_in_group)
    joined = rows.join(spans.select(F.col("rid").alias(rid), F.col("spans").alias(cuts)), rid, "left") \
        .select(packed, cuts, *own)
    order = [*[c for c in docs.columns if c != into], into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if z is None else _unzip(z) for z in batch.column(0).to_pylist()]
            cut = [_cut(r or b"", s, least_words) for r, s in zip(raw, batch.column(1).to_pylist(), strict=True)]
            made = dict(zip(own, batch.columns[2:], strict=True))
            made[text] = pa.array([None if r is None else r.decode() for r in raw], pa.string())
            made[into] = pa.StructArray.from_arrays([
                pa.array([len(r or b"") for r in raw], pa.int64()),
                pa.array([len(r or b"") - len(k) for r, (k, _) in zip(raw, cut, strict=True)], pa.int64()),
                pa.array([n for _, n in cut], pa.int64()), pa.array([k for k, _ in cut], pa.binary()),
                pa.array([k.decode(errors="ignore") for k, _ in cut], pa.string()),
            ], names=["n_bytes", "n_removed", "n_spans", "kept", "kept_text"])
            yield pa.RecordBatch.from_arrays([made[c] for c in order], names=order)

    found = StructType().add("n_bytes", LongType()).add("n_removed", LongType()).add("n_spans", LongType()) \
        .add("kept", BinaryType()).add("kept_text", StringType())
    fields = {f.name: f for f in docs.schema.fields} | {text: StructField(text, StringType()), into: StructField(into, found)}
    return joined.mapInArrow(run, StructType([fields[c] for c in order]))
