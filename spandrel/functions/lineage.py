"""Cuts lineage by checkpoints in the folder that all executors share, and counts up to a bound."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir: computed once, whatever reads it, and still there if an executor is lost. A local session may do without the setting."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="spandrel-"))
    return df.checkpoint()


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows
