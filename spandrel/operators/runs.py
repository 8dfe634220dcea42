"""Summaries of recorded runs: steps, rejections, questions asked, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_steps(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls (run, place, key) with found_by: the kind of an earlier result (run, place, key, kind) that named the key; reference, then amendment, then search; else none."""
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(("reference", "amendment", "search"))], F.lit(3))
    earlier = calls.join(results.select("run", F.col("place").alias("seen_at"), "key", "kind"), ["run", "key"], "left")
    best = earlier.groupBy("run", "place", "key").agg(F.min_by(F.when(F.col("seen_at") < F.col("place"), F.col("kind")), F.when(F.col("seen_at") < F.col("place"), order).otherwise(9)).alias("found_by"))
    return best.withColumn("found_by", F.coalesce("found_by", F.lit("none")))


def problems(feedback: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, drafts): in how many drafts' feedback (draft, text) a line that starts with "- " fits each rule; a line counts for the first rule that fits it."""
    lines = feedback.select("draft", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").startswith("- "))
    rule: Column = F.coalesce(*[F.when(F.col("line").contains(part), name) for name, part in rules], F.lit("other"))
    return lines.groupBy(rule.alias("rule")).agg(F.count_distinct("draft").alias("drafts"))


def answer_open_calls(calls: DataFrame, results: DataFrame, text: str) -> DataFrame:
    """results (call, text) and one of the given text for each call without any."""
    return results.select("call", "text").unionByName(calls.join(results, "call", "left_anti").select("call", F.lit(text).alias("text")))


def tool_use(calls: DataFrame) -> DataFrame:
    """(tool, calls, questions): how often each tool was called, and in how many questions."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_distinct("question").alias("questions"))


def asks(answers: DataFrame) -> DataFrame:
    """Confusion counts of asked and should_ask."""
    a, s = F.col("asked"), F.col("should_ask")
    return answers.agg(F.count_if(a & s).alias("right"), F.count_if(a & ~s).alias("needless"), F.count_if(~a & s).alias("missed"), F.count_if(~a & ~s).alias("silent"))


def stored_uploads(uploads: DataFrame, now: Column, ttl: str, per_thread: int, total_bytes: int) -> DataFrame:
    """Uploads (thread, sha256, created, size) that stay: each content once a thread, not expired, the newest per thread, while their thread's sizes fit."""
    alive = uploads.filter(F.col("created") >= now - F.expr(f"INTERVAL {ttl}"))
    once = alive.groupBy("thread", "sha256").agg(F.min(F.struct("created", "size")).alias("x")).select("thread", "sha256", "x.created", "x.size")
    newest = Window.partitionBy("thread").orderBy(F.desc("created"), "sha256")
    placed = once.withColumn("place_", F.row_number().over(newest)).withColumn("sum_", F.sum("size").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.filter((F.col("place_") <= per_thread) & (F.col("sum_") <= total_bytes)).drop("place_", "sum_")


def verdicts(reviews: DataFrame) -> DataFrame:
    """(draft, passed, problems) from reviews (draft, verdict, note): passed if all are ok; problems are the notes of those that failed, sorted."""
    return reviews.groupBy("draft").agg(F.bool_and(F.col("verdict") == "ok").alias("passed"), F.array_sort(F.collect_list(F.when(F.col("verdict") == "fail", F.col("note")))).alias("problems"))


def quote_pages(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (doc, quote, page) with found_on: the first page from the stated one up to ten further that holds the quote, letters and digits alone compared."""
    form = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    p = pages.select("doc", F.col("page").alias("on"), form("text").alias("whole"))
    met = quotes.join(p, "doc").filter((F.col("on") >= F.col("page")) & (F.col("on") <= F.col("page") + 10) & F.col("whole").contains(form(F.col("quote"))))
    first = met.groupBy("doc", "quote", "page").agg(F.min("on").alias("found_on"))
    return quotes.join(first, ["doc", "quote", "page"], "left")
