"""A registry of queries with their SQL, and readers of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL if SQL can express it.

    Columns named in dates are returned as ISO text, by both.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates}) if dates else f(spark, sf_dir)
        if sql:
            as_text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({as_text}) FROM ({sql}) AS q" if dates else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most partitions that a table of few splits is spread over.
SPREAD = 64


def spread(df: DataFrame, each: int | None = None) -> DataFrame:
    """df over as many partitions as there are cores, up to SPREAD, where its files have fewer splits: for work that costs much more than reading. Tables of many splits stay as they are.

    With each, over at least so many that a partition has that many rows on average.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, SPREAD)
    if each:
        wanted = max(wanted, -(-df.count() // each))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
