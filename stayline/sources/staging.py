"""Share one evaluation between several passes.

Where the session names a checkpoint folder (shared storage on a cluster), lineage is cut
there: a lost executor costs a re-read and not a re-computation, and every pass sees the same
rows in the same partitions. Without one, rows are kept by the executors, and what is lost
is computed again. Nothing is ever written to a machine's own folder.
"""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def has_checkpoint_dir(spark: SparkSession) -> bool:
    """Whether there is a folder to cut lineage in; the one the session names is used."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            return False
        context.setCheckpointDir(named)
    return True


def need_checkpoint_dir(spark: SparkSession) -> None:
    """For jobs of hundreds of rounds, whose lineage has to be cut in the midst of a fit.

    A local session gets a temporary folder where none is named. A cluster session is refused: its executors
    would not see each other's files, and without a folder one lost executor repeats every round.
    """
    if has_checkpoint_dir(spark):
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("boosting needs spark.checkpoint.dir, a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stayline-"))


def stage(df: DataFrame) -> DataFrame:
    if has_checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
