"""Reading customer tables: explicit-schema files, ad-hoc uploads, literal rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stayline.catalogue import customer_schema


#: Where rows that don't parse are kept whole, if asked for.
BROKEN = "_broken_row"


def read_customers(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
    infer: bool = False, mode: str = "FAILFAST", broken: bool = False,
) -> DataFrame:
    """Read customer CSVs with a header row; columns are matched by name.

    The header gives the order, the schema (by default the catalogue) the types; columns it
    doesn't know are strings, columns the file doesn't have stay absent. Files whose header
    differs from the first one's are refused. A value that doesn't parse fails the query;
    `mode="PERMISSIVE"` makes it null, and `broken=True` then adds the row's text as BROKEN.
    `infer=True` is for uploads of unknown types; it costs one more pass over the file.
    """
    reader = spark.read.option("header", True)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    known = {f.name: f.dataType for f in (schema or customer_schema()).fields}
    header = reader.csv(path if isinstance(path, str) else path[0]).columns
    typed = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    reader = reader.option("enforceSchema", False).option("mode", mode)
    if broken:
        typed = typed.add(BROKEN, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", BROKEN)
    return reader.schema(typed).csv(path)


def requests(spark: SparkSession, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    """One-off scoring requests as a table; absent keys become absent columns."""
    rows = list(rows)
    known = customer_schema()
    names = [f.name for f in known.fields if any(f.name in r for r in rows)]
    schema = T.StructType([known[n] for n in names])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def customers(
    spark: SparkSession, default_path: str | None = None, upload_path: str | None = None,
    view: str = "current_customers",
) -> DataFrame:
    """The table reports run on: an upload if given, else the last one, else the default.

    The choice is kept as a temporary view. Passing `default_path` without an
    upload goes back to the default table.
    """
    if upload_path:
        df = read_customers(spark, upload_path, infer=True)
    elif default_path:
        df = (spark.read.parquet(default_path) if default_path.endswith(".parquet")
              else read_customers(spark, default_path))
    else:
        return spark.table(view)
    df.createOrReplaceTempView(view)
    return df


def keep_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a derived or scored table once and read it back, for the reports that share it.

    Partitioning by a filter column (Location, Segment) lets filtered reports skip
    the other folders. The rebalance hint gathers each value's rows into files of
    sensible size and splits a value that holds much of the table.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)
