"""Schema reconciliation: defaults, unknown categories, null policy, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.catalogue import (
    CATEGORICAL, CUSTOMER_COLUMNS, DEFAULT_OF, INPUT_NAMES, NON_FEATURES, NUMERIC, TYPE_OF, used_by,
)

Vocabulary = Mapping[str, Sequence[str]]

#: Label tables of a column up to this size are sent to every task; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def fill_missing_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add every absent catalogue column as its constant default."""
    filled = [c.name for c in CUSTOMER_COLUMNS if c.name not in df.columns]
    constants = {n: F.lit(DEFAULT_OF[n]).cast(TYPE_OF[n]) for n in filled}
    return (df.withColumns(constants) if constants else df), filled


def apply_null_policy(df: DataFrame, null_rows: str = "fail") -> DataFrame:
    """Null numeric cells of present columns: `fail`, `default` or `keep`."""
    if null_rows == "keep":
        return df
    if null_rows not in ("fail", "default"):
        raise ValueError(f"unknown null policy: {null_rows}")
    present = [n for n in NUMERIC if n in df.columns]
    if not present:
        return df
    if null_rows == "default":
        return df.withColumns({
            n: F.coalesce(F.col(n), F.lit(DEFAULT_OF[n]).cast(df.schema[n].dataType)) for n in present})
    # A filter, not a column: it holds whatever columns are selected later.
    first = F.coalesce(*[F.when(F.col(n).isNull(), F.lit(n)) for n in present])
    broken = F.raise_error(F.concat(F.lit("null value in "), first)).cast("boolean")
    return df.filter(F.when(first.isNotNull(), broken).otherwise(F.lit(True)))


def label_table(df: DataFrame, columns: Sequence[str] = CATEGORICAL, nulls: bool = False) -> DataFrame:
    """(column, label): the distinct labels of each column, however many there are; with `nulls`, null is one."""
    wide = df.select([F.col(c).cast("string").alias(c) for c in columns])
    labels = wide.unpivot([], list(columns), "column", "label")
    return (labels if nulls else labels.filter(F.col("label").isNotNull())).distinct()


def joined_labels(table: DataFrame, columns: Sequence[str]) -> list[tuple[str, DataFrame]]:
    """For each column that has labels, its rows of a label table, one a label, ready to be joined in.

    They are broadcast where their summed size is at most BROADCAST_BYTES.
    """
    size = F.sum(F.coalesce(F.octet_length("label"), F.lit(0)) + F.lit(64))
    sizes = {r["column"]: r["bytes"] for r in
             table.filter(F.col("column").isin(list(columns))).groupBy("column").agg(size.alias("bytes")).collect()}
    found = []
    for name in columns:
        if name in sizes:
            known = table.filter(F.col("column") == name).drop("column").dropDuplicates(["label"])
            found.append((name, F.broadcast(known) if sizes[name] <= BROADCAST_BYTES else known))
    return found


def fallback_label(labels: Sequence[str], column: str, unknown: str) -> str:
    """`first`: the first label. `default`: the catalogue default, if it is a label."""
    if unknown not in ("first", "default"):
        raise ValueError(f"unknown category mode: {unknown}")
    default = DEFAULT_OF[column]
    return default if unknown == "default" and default in labels else labels[0]


def sanitize_categories(
    df: DataFrame, vocabulary: Vocabulary | DataFrame, unknown: str = "first"
) -> DataFrame:
    """Replace null and unknown labels by the fallback label.

    The vocabulary is a `label_table`, or lists that are made into one: a left join a
    column at every size. `first` of a table is its smallest label.
    """
    if isinstance(vocabulary, DataFrame):
        table, given = vocabulary, {}
    else:
        given = {c: labels for c, labels in vocabulary.items() if c in df.columns and labels}
        if not given:
            return df
        table = df.sparkSession.createDataFrame(
            [(c, label) for c, labels in given.items() for label in dict.fromkeys(labels)],
            "column string, label string")
    # A row for each column.
    defaults = [str(DEFAULT_OF[c]) for c in CATEGORICAL]
    found = table.groupBy("column").agg(
        F.min("label").alias("first"),
        F.collect_set(F.when(F.col("label").isin(defaults), F.col("label"))).alias("defaults")).collect()
    labels = {r["column"]: [r["first"], *r["defaults"]] for r in found}
    for name, known in joined_labels(table, [c for c in labels if c in df.columns]):
        fallback = fallback_label(given.get(name, labels[name]), name, unknown)
        known = known.select(F.col("label").alias("_known"))
        df = df.join(known, F.col(name).cast("string") == F.col("_known"), "left").withColumn(
            name, F.coalesce("_known", F.lit(fallback))).drop("_known")
    return df


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, non_null), one pass for all columns."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows_"),
        *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    lines = [
        F.struct(F.lit(c).alias("column"),
                 (F.col("rows_") - F.col(f"n_{i}")).alias("nulls"),
                 F.col(f"n_{i}").alias("non_null"))
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*lines)))


def _status_of(df: DataFrame) -> list[tuple[str, str]]:
    known = [(n, "present" if n in df.columns else "missing") for n in INPUT_NAMES]
    extra = [(n, "extra") for n in df.columns if n not in INPUT_NAMES + NON_FEATURES]
    return known + extra


def schema_report(df: DataFrame) -> DataFrame:
    """(column, status, non_null): catalogue columns present or missing, and extra ones.

    The id and the two labels are neither required nor extra.
    """
    status = df.sparkSession.createDataFrame(_status_of(df), "column string, status string")
    return status.join(null_counts(df), "column", "left").select(
        "column", "status", F.coalesce("non_null", F.lit(0).cast("long")).alias("non_null"))


def completeness(df: DataFrame) -> DataFrame:
    """One row: customers, columns found, how much of the catalogue is provided."""
    missing = sorted(n for n in INPUT_NAMES if n not in df.columns)
    total = len(INPUT_NAMES)
    score = round((1 - len(missing) / total) * 100)
    band = "high" if score >= 80 else "medium" if score >= 50 else "low"
    return df.agg(F.count(F.lit(1)).alias("customers")).select(
        "customers",
        F.lit(len(df.columns)).cast("long").alias("columns_found"),
        F.lit(total - len(missing)).cast("long").alias("provided"),
        F.lit(", ".join(missing)).alias("missing"),
        F.lit(score).cast("long").alias("completeness"),
        F.lit(score == 100).alias("is_full"),
        F.lit(band).alias("band"),
    )


def column_catalogue(df: DataFrame) -> DataFrame:
    """The supported columns, and how many rows of `df` provide each of them."""
    rows = [(c.name, c.kind.capitalize(), str(c.default), ", ".join(used_by(c.name)))
            for c in CUSTOMER_COLUMNS]
    listing = df.sparkSession.createDataFrame(
        rows, "column string, type string, default_value string, required_for string")
    return listing.join(null_counts(df), "column", "left").select(
        *listing.columns, F.coalesce("non_null", F.lit(0).cast("long")).alias("rows_provided"))


def table_profile(df: DataFrame) -> DataFrame:
    """(position, column, dtype, rows, non_null): shape and types of a table."""
    order = df.sparkSession.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position long, column string, dtype string")
    return order.join(null_counts(df), "column").select(
        "position", "column", "dtype", (F.col("nulls") + F.col("non_null")).alias("rows"), "non_null")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
