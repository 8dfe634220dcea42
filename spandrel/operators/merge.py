"""Merges of stored tables with new rows, as joins: the result is written as a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of new in place of, or beside, those of the same keys."""
    return new.unionByName(stored.join(new.select(keys), keys, "left_anti"))


def insert_missing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the rows of new whose keys it lacks; of several new rows of a key, the first by all columns."""
    once = F.row_number().over(Window.partitionBy(*keys).orderBy(*new.columns))
    fresh = new.withColumn("once_", once).filter("once_ = 1").drop("once_").join(stored.select(keys), keys, "left_anti")
    return stored.unionByName(fresh)


def replace(stored: DataFrame, new: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Delete and insert: rows of stored in scope (by keys) give way to new."""
    return stored.join(scope.select(keys).distinct(), keys, "left_anti").unionByName(new)


def cascade(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of child whose parent is still there."""
    return child.join(parent.select(keys).distinct(), keys, "left_semi")


def mark_missing(stored: DataFrame, seen: DataFrame, keys: list[str], day: Column, column: str = "missing_since") -> DataFrame:
    """stored with column set to day where the key wasn't seen (a day already there stays), and cleared where it was."""
    flagged = stored.join(seen.select(keys).distinct().withColumn("seen_", F.lit(True)), keys, "left")
    return flagged.withColumn(column, F.when(F.col("seen_").isNull(), F.coalesce(column, day))).drop("seen_").select(stored.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("place_ = 1").drop("place_")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of df in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def union_unique(tables: list[DataFrame]) -> DataFrame:
    """The distinct rows of several tables with equal columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.dropDuplicates()


def changes(stored: DataFrame, fetched: DataFrame, types: list[str]) -> DataFrame:
    """fetched (url, file_type, version, failed, sha256) with status and the sha256 to keep, against stored (url, version, sha256).

    One row per url, the first by all columns. EXCLUDED types aren't fetched;
    an unchanged version isn't either (SAME_VERSION); the rest are FAILED, NEW,
    UNCHANGED or UPDATED by their content.
    """
    once = first_per_key(fetched, ["url"], [F.col(c) for c in fetched.columns])
    old = stored.select("url", F.col("version").alias("old_version"), F.col("sha256").alias("old_sha256"))
    status = (
        F.when(~F.lower("file_type").isin([t.lower() for t in types]), "EXCLUDED")
        .when(F.col("version").isNotNull() & (F.col("version") == F.col("old_version")), "SAME_VERSION")
        .when(F.col("failed"), "FAILED")
        .when(F.col("old_sha256").isNull(), "NEW")
        .when(F.col("old_sha256") == F.col("sha256"), "UNCHANGED")
        .otherwise("UPDATED")
    )
    judged = once.join(old, "url", "left").withColumn("status", status)
    kept = F.when(F.col("status").isin("NEW", "UPDATED", "UNCHANGED"), F.col("sha256")).otherwise(F.col("old_sha256"))
    return judged.select("url", "file_type", "version", "status", kept.alias("sha256"))
