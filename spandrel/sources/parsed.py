"""A store of parsed files that is added to: what a parser has read once is not read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHED, PARSED, FAILED = "cached", "parsed", "failed"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store at a path: rows of the schema with parser; empty if nothing has been stored yet. A row is there once for each file and parser."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, parser string")
    return spark.read.schema(f"{schema}, parser string, run string").parquet(path).drop("run").dropDuplicates(["sha256", "parser"])


def parse_new(files: DataFrame, store: DataFrame, parser: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(sha256, status, error, ...the store's columns but parser): every file, read by `parser` now or before.

    files: (sha256, ...), of which each content counts once. parse takes the
    files that the store doesn't have from this parser, and gives (sha256, error,
    ...) with a null error for what could be read; a file that it leaves out has
    failed. What another parser has stored is not used. Filters on parser reach
    the store's folders.
    """
    columns = [c for c in store.columns if c not in ("sha256", "parser")]
    distinct = files.dropDuplicates(["sha256"])
    had = store.filter(F.col("parser") == parser).drop("parser")
    known = had.join(distinct.select("sha256"), "sha256", "left_semi").select("sha256", F.lit(CACHED).alias("status"), F.lit(None).cast("string").alias("error"), *columns)
    fresh = distinct.join(had.select("sha256"), "sha256", "left_anti")
    read = parse(fresh)
    met = fresh.select("sha256").join(read.withColumn("read_", F.lit(True)), "sha256", "left")
    error = F.when(F.col("read_").isNull(), "not read").otherwise(F.col("error"))
    new = met.select("sha256", F.when(error.isNull(), PARSED).otherwise(FAILED).alias("status"), error.alias("error"), *columns)
    return known.unionByName(new)


def add(results: DataFrame, path: str, parser: str, run: str) -> None:
    """Stores what a run has parsed, under its parser and its own name: a run that is done again replaces itself, and readers of other parsers don't see it. Failed files are not stored, and so are tried again."""
    kept = results.filter(F.col("status") == PARSED).drop("status", "error")
    kept.write.mode("overwrite").parquet(f"{path}/parser={parser}/run={run}")
