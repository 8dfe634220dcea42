"""Lookups over visible documents: lists, outlines, sections with their references, date calculations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import dates

# Document groups in the order of lists.
GROUPS = ("agreement", "procurement", "support")


class NotFound(LookupError):
    """Nothing has the key."""


class Ambiguous(LookupError):
    """Several things have the key."""


def group_order(column: str) -> Column:
    return F.coalesce(*[F.when(F.col(column) == g, i) for i, g in enumerate(GROUPS)], F.lit(len(GROUPS)))


def list_documents(files: DataFrame, sections: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of files (sha256, title, document_group) with visible sections, by group, title and key, with their number and the total."""
    counted = sections.groupBy("sha256").agg(F.count("*").alias("sections"))
    found = files.join(counted, "sha256")
    total = found.agg(F.count("*").alias("total"))
    order = [group_order("document_group"), "title", "sha256"]
    return found.join(F.broadcast(total)).orderBy(*order).offset(offset).limit(limit)


def outline(sections: DataFrame, visible: DataFrame, sha256: str) -> tuple[DataFrame, int]:
    """The visible sections of a file in order, and how many are held back."""
    own = sections.filter(F.col("sha256") == sha256)
    shown = own.join(visible.select("sha256", "section_position"), ["sha256", "section_position"], "left_semi")
    return shown.orderBy("section_position"), own.count() - shown.count()


def read_section(sections: DataFrame, visible: DataFrame, sha256: str, number: str | None = None, position: int | None = None) -> DataFrame:
    """The one visible section of a file with a number or a position; NotFound or Ambiguous otherwise."""
    if (number is None) == (position is None):
        raise ValueError("give a number or a position")
    own = sections.filter((F.col("sha256") == sha256) & (F.col("number") == number if number is not None else F.col("section_position") == position))
    found = own.join(visible.select("sha256", "section_position"), ["sha256", "section_position"], "left_semi")
    n = len(found.limit(2).collect())
    if n != 1:
        raise (Ambiguous if n else NotFound)(f"{sha256[:12]} {number or position}")
    return found


def section_references(references: DataFrame, targets: DataFrame, visible: DataFrame) -> DataFrame:
    """references (reference_id, ...) with shown, an array of visible targets, and held_back, the number of others.

    targets: (reference_id, place, target_sha256, target_section_position); a null position is the whole file.
    """
    sections = visible.select(F.col("sha256").alias("target_sha256"), F.col("section_position").alias("target_section_position")).distinct().withColumn("one_", F.lit(True))
    files = visible.select(F.col("sha256").alias("target_sha256")).distinct().withColumn("file_", F.lit(True))
    seen = targets.join(sections, ["target_sha256", "target_section_position"], "left").join(files, "target_sha256", "left")
    can = F.when(F.col("target_section_position").isNull(), F.col("file_").isNotNull()).otherwise(F.col("one_").isNotNull())
    item = F.struct("place", "target_sha256", "target_section_position")
    met = seen.withColumn("can_", can).groupBy("reference_id").agg(F.array_sort(F.collect_list(F.when(F.col("can_"), item))).alias("shown"), F.count_if(~F.col("can_")).alias("held_back"))
    return references.join(met, "reference_id", "left").withColumns({"shown": F.coalesce("shown", F.array().cast("array<struct<place:int,target_sha256:string,target_section_position:bigint>>")), "held_back": F.coalesce("held_back", F.lit(0))})


def calculate_date(df: DataFrame, start: str, amount: str, unit: str, days: DataFrame, include_start: bool = False) -> DataFrame:
    """df with result, weekday (1 Monday to 7 Sunday), working_day, and with_eves: the result if eves counted as holidays, where it differs."""
    n = F.col(amount)
    counted = df.withColumn("n_", F.when(F.lit(include_start) & (n != 0), n - F.signum(n).cast("int")).otherwise(n).cast("int"))
    moved = dates.shift(counted, start, "n_", unit, "result", days)
    eves = dates.add_working_days(moved, start, "n_", "eves_", days, eves_off=True)
    known = days.select(F.col("day").alias("result"), F.col("working").alias("working_day"))
    out = eves.withColumn("with_eves", F.when((F.col(unit) == "working_days") & (F.col("eves_") != F.col("result")), F.col("eves_")))
    return out.join(F.broadcast(known), "result", "left").withColumn("weekday", F.weekday("result") + 1).drop("n_", "eves_")


def page_list(pages: DataFrame, by: str, page: str) -> DataFrame:
    """(by, pages): the distinct pages of each key as ranges, as in "1-3, 7"."""
    distinct = pages.select(by, page).distinct()
    island = distinct.withColumn("run_", F.col(page) - F.row_number().over(Window.partitionBy(by).orderBy(page)))
    runs = island.groupBy(by, "run_").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("pages"))


def outline_gaps(numbers: DataFrame) -> DataFrame:
    """(doc, number) that are missing though both the one before and the one after, or the parent and the one after, are there; numbers: (doc, number)."""
    last = F.regexp_extract("number", r"(\d+)$", 1).cast("int")
    head = F.regexp_replace("number", r"\d+$", "")
    follow = numbers.filter(last > 1).select("doc", F.concat(head, (last - 1).cast("string")).alias("number"), F.regexp_replace(head, r"\.$", "").alias("parent"), (last > 2).alias("inner"), F.concat(head, (last - 2).cast("string")).alias("before"))
    gaps = follow.join(numbers, ["doc", "number"], "left_anti")
    known = numbers.select("doc", F.col("number").alias("key")).distinct()
    met = gaps.withColumn("key", F.when(F.col("inner"), F.col("before")).otherwise(F.col("parent")))
    return met.join(known, ["doc", "key"], "left_semi").unionByName(met.filter("key = ''")).select("doc", "number").distinct()


def similar_titles(phrases: DataFrame, titles: DataFrame, by: list[str], least: float = 0.5, top: int = 8) -> DataFrame:
    """The titles of a page most like each phrase: 1 - edit distance over the longer length, at least `least`, the best `top`."""
    low = lambda c: F.lower(F.trim(c))
    share = 1 - F.levenshtein(low("phrase"), low("title")) / F.greatest(F.length("phrase"), F.length("title"), F.lit(1))
    met = phrases.join(titles, by).withColumn("similarity", F.round(share, 6)).filter(F.col("similarity") >= least)
    w = Window.partitionBy(*by, "phrase").orderBy(F.desc("similarity"), "title")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def version_date(sources: DataFrame) -> DataFrame:
    """(sha256, version_date, rule): of dates found by rules (sha256, rule, day), the latest of the first rule that has one; rules go by name."""
    first = sources.filter("day IS NOT NULL").groupBy("sha256", "rule").agg(F.max("day").alias("version_date"))
    return first.groupBy("sha256").agg(F.min_by(F.struct("version_date", "rule"), "rule").alias("x")).select("sha256", "x.version_date", "x.rule")
