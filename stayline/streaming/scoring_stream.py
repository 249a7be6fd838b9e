"""Score customer files as they arrive in a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stayline.catalogue import NUMERIC, customer_schema
from stayline.plans.scoring import Scorer, score_bulk
from stayline.sources.customers import BROKEN, read_customers

#: What Spark's file reader tells about a file; only the path is read.
FILES = "path string, modificationTime timestamp, length long, content binary"


def _split_off(rows: DataFrame, nulls_too: bool) -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and rows that don't parse or have a null number."""
    bad = F.col(BROKEN).isNotNull()
    if nulls_too:
        bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rows.columns if c in NUMERIC], bad)
    return rows.filter(~bad).drop(BROKEN), rows.filter(bad)


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The paths under their first line that isn't blank, found in one pass over the files."""
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    first = spark.read.text(paths).filter(F.trim("value") != "").select(
        "value", place.alias("place"), F.col("_metadata.file_path").alias("path"))
    found: dict[str, list[str]] = {}
    for row in first.groupBy("path").agg(F.min_by("value", "place").alias("header")).collect():  # a row a file
        found.setdefault(row["header"], []).append(row["path"])
    return {header: sorted(found[header]) for header in sorted(found)}


def score_stream(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, scorer: Scorer,
    schema: T.StructType | None = None, null_rows: str = "reject", reject_dir: str | None = None,
    once: bool = True, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Bulk-score every new CSV in `in_dir` into parquet files in `out_dir`.

    The stream carries file names. Files of a batch that have the same header are read and written
    together, so a batch takes a few jobs for each distinct header, however many files it has; files may
    differ in column order and set, and a file without any line gives nothing. Rows that don't parse, and with `null_rows="reject"` rows with a null
    number, go as text to `reject_dir` (default: a sibling of `out_dir`) and don't stop the stream;
    `null_rows="default"` fills nulls. Output lies in one folder per batch, which a repeated batch
    overwrites, so each file counts once. `once` stops after the files present now.
    """
    rejected = reject_dir or out_dir.rstrip("/") + "_rejected"
    types = schema or customer_schema(with_labels=False)

    def work(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # at most files_per_batch
        for k, alike in enumerate(_headers(spark, paths).values()):
            rows = read_customers(spark, alike, types, mode="PERMISSIVE", broken=True)
            good, bad = _split_off(rows, null_rows == "reject")
            scored, _ = score_bulk(good, scorer, null_rows="keep" if null_rows == "reject" else null_rows)
            place = f"batch={number}/header={k}"
            scored.write.mode("overwrite").parquet(f"{out_dir}/{place}")
            bad.select(F.col("_metadata.file_path").alias("path"), F.to_json(F.struct(*bad.columns)).alias("row")) \
                .write.mode("overwrite").parquet(f"{rejected}/{place}")

    names = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv") \
        .option("maxFilesPerTrigger", files_per_batch).load(in_dir).select("path")
    writer = names.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
