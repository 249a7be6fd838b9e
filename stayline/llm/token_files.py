"""Token-id output: flat files of unsigned integers with 64-bit document offsets.

Documents are range-partitioned by id; each task writes one shard of three files, the ids
(`.bin`, little-endian unsigned: 16 bits where the vocabulary and the end id fit, else 32), the
offsets (`.idx`, little-endian signed 64-bit: documents + 1 positions within the shard) and the
documents' ids (`.key`). A prefix sum over the shards' id counts,
one number per partition, gives each shard its base. Reading maps the files into memory.

The folder must be on a file system that every executor mounts. A task writes under a name of
its own and renames, so a repeated or speculative attempt leaves one whole shard.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm.byte_ids import encoder
from stayline.llm.common import text_of


def local_path(folder: str) -> str:
    """The mounted path of a shared folder."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files are mapped into memory and need a mounted folder, not {folder}")
    return unquote(parts.path)


def id_type(tokenizer: str, end_id: int | None) -> str:
    """The narrowest of the two file types that holds every id."""
    most = max(encoder(tokenizer).tokenizer.get_vocab_size(), (end_id or 0) + 1)
    return "<u2" if most <= 1 << 16 else "<u4"


def _replace(path: str, data: bytes | list[bytes]) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as file:
        file.writelines([data] if isinstance(data, bytes) else data)
    os.replace(own, path)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2,
    key: str = "doc_id", text: str = "text", partitions: int | None = None,
) -> DataFrame:
    """Write shards in ascending order of `key`; returns one row per shard: shard, docs, ids, base.

    A null text is empty and gives the end id alone. Null keys come first; rows with equal keys
    stay in the order in which the table is read, and may lie in several shards. An empty table writes no shard.
    """
    spark, root = docs.sparkSession, local_path(folder)
    os.makedirs(root, exist_ok=True)
    # The row's number splits a key that many rows have; keys and numbers alone are sampled for the ranges.
    rows = docs.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), text_of(text).alias("text"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("key").asc_nulls_first(), F.col("row").asc()
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    width = id_type(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"{root}/shard-{shard:08d}"
        own = f"{name}.{uuid.uuid4().hex}"
        coder, keys, ends, at = encoder(tokenizer), [], [0], 0
        with open(own, "wb") as file:
            for batch in batches:
                keys += batch.column(0).to_pylist()
                for ids in coder.encode(batch.column(1).to_pylist()):
                    file.write(np.frombuffer(ids + tail, "<u4").astype(width).tobytes())
                    at += (len(ids) + len(tail)) // 4
                    ends.append(at)
        if not keys:
            os.remove(own)
            return
        os.replace(own, f"{name}.bin")
        _replace(f"{name}.idx", np.array(ends, "<i8").tobytes())
        known = np.array([k is not None for k in keys])
        _replace(f"{name}.key", [np.array([k or 0 for k in keys], "<i8").tobytes(), known.tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(keys)], "ids": [at]})

    sizes = rows.mapInArrow(run, "shard long, docs long, ids long").collect()  # one row a partition
    base, out = 0, []
    for row in sorted(sizes):
        out.append((row.shard, row.docs, row.ids, base))
        base += row.ids
    return spark.createDataFrame(out, "shard long, docs long, ids long, base long")


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame, width: str = "<u2") -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens and ids (bytes, unsigned 32-bit).

    `width` is the files' type, as `id_type` gives it.
    """
    root = local_path(folder)
    n = max(1, min(shards.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                name = f"{root}/shard-{shard:08d}"
                ends = np.memmap(f"{name}.idx", "<i8", "r")
                size = len(ends) - 1
                raw = np.memmap(f"{name}.key", "u1", "r")
                keys, known = raw[:8 * size].view("<i8"), raw[8 * size:].view(bool)
                ids = np.memmap(f"{name}.bin", width, "r") if ends[-1] else np.zeros(0, width)
                first = 0
                while first < size:  # pieces of about four million ids
                    last = max(first + 1, int(np.searchsorted(ends, ends[first] + 4_000_000)) - 1)
                    last = min(last, size)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[first:last], mask=~known[first:last]),
                        pa.array(ends[first:last] + base),
                        pa.array(np.diff(ends[first:last + 1])),
                        pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[first:last], ends[first + 1:last + 1], strict=True)], pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])
                    first = last

    return shards.repartition(n, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")
