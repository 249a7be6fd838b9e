"""The corpus pipeline: documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import language, packing, repeats, simhash
from stayline.llm.common import fresh_names, importable, kept, table
from stayline.llm.queries import BYTE_BPE, held_out

#: Stages run Python workers over invented prose; SQL can't express them.
ORACLE_SQL = None


#: A passage of this many whole words that also occurs elsewhere is cut; it is looked for by windows of
#: REPEAT_WINDOW bytes, about as long as 50 short words.
REPEAT_WORDS, REPEAT_WINDOW = 50, 256


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: null and empty texts and those without a letter.

    Equal code lengths go to the first language by name, so a tie keeps its document. Repeated rows are judged
    one by one; an empty table gives an empty one; columns of any name pass through.
    """
    importable(spark)
    model = language.fit(docs.filter(~held_out()))
    if not model.names:  # no labelled text to learn from: only what no model could tell goes
        return docs.filter(language.lettered()(F.col("text")))
    name, = fresh_names(docs.columns, "found")
    found = language.predictor(docs, model)(F.col("text"))
    return docs.withColumn(name, found).filter(F.col(name)["lang_pred"] != language.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of each near-duplicate group; one row, if ids repeat.

    Null ids are kept only where a group has no other. Null, empty and blank texts are one group. An empty
    table gives an empty one; columns of any name pass through.
    """
    importable(spark)
    # Rows are numbered, so that exactly one row of a group stays whatever the ids are; the numbers are
    # stored, since another job may split a scan in another way.
    row, = fresh_names([*docs.columns, "component_id", "unknown"], "row")
    rows = kept(docs.withColumn(row, F.monotonically_increasing_id()))
    found = simhash.near_duplicates(rows.select(F.col(row), "text"), key=row)
    groups = rows.select(row, "doc_id").join(found.select(F.col("doc_id").alias(row), "component_id"), row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", row))
    stays = groups.groupBy("component_id").agg(first.alias("first")).select(F.col("first")[row].alias(row))
    return rows.join(stays, row, "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 whole words or more that also occur elsewhere; shorter repeats stay.

    A null text stays null, a text that is all repeat becomes empty, repeated rows repeat each other. An empty
    table gives an empty one; columns of any name pass through.
    """
    importable(spark)
    name, = fresh_names(docs.columns, "found")
    found = repeats.remove_repeats(docs, window=REPEAT_WINDOW, into=name, least_words=REPEAT_WORDS)
    text = F.when(F.col("text").isNotNull(), F.col(name)["kept_text"])
    return found.withColumn("text", text) \
        .withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) \
        .select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into windows of 2048 tokens; the row of a piece carries its ids.

    A null or empty text gives its end id alone, a null doc_id stays null, repeated rows are packed one by
    one, a longer text is cut into pieces; ties between windows go to the older one. An empty table gives no rows.
    """
    importable(spark)
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("language_id", keep_known_language),
    ("simhash_dedup", drop_near_duplicates),
    ("repeat_removal", cut_repeats),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = kept(docs)
    return docs
