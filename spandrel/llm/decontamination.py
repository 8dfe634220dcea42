"""Benchmark decontamination by 13-word windows, in DataFrame operations alone.

Test items and documents are split into normalised words. A document word is hit
if it lies in an occurrence of a window of 13 consecutive item words (an item of
fewer words is one window). To find the occurrences without testing every
position, each window length L is probed by shorter n-grams of g = (L+1)/2 words
at every (L-g+1)-th position of the document only: any occurrence of a window
holds one of them whole. The hashes of all the items' g-grams are a broadcast
hash set of checked size, against which the probes of a document are held as it
is read; the windows around those found are written out and joined, as text,
with the items' windows. Only counts and found windows are shuffled. If the items
are too many for a broadcast, the probes are joined by a shuffle instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import lower_ascii, small_enough, table, written

WINDOW = 13
#: A document is contaminated if at least 1 in so many of its words is hit.
SHARE = 20
#: Most n-grams in the broadcast set (8 bytes each, and as much again for the table), most windows, and most contaminated texts in a broadcast table.
SET_LIMIT, WINDOW_LIMIT, BAD_LIMIT = 2_000_000, 500_000, 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and characters beyond ASCII; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _probe(length: int) -> tuple[int, int]:
    """Words of a probe and the step between probes, for windows of a length."""
    size = (length + 1) // 2
    return size, length - size + 1


def _positions(last: Column, step: int = 1) -> Column:
    """1, 1+step, ... up to last; none if last is below 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, gram): the distinct windows of every item, as words joined by spaces."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    grams = F.transform(_positions(F.size("w") - size + 1), lambda i: F.concat_ws(" ", F.slice("w", i, size)))
    return items.select("item_id", size.alias("size"), F.explode(F.array_distinct(grams)).alias("gram"))


def _grams(w: Column, places: Column, size: int) -> Column:
    """array<struct<at, size, h>>: the hashes of the g-grams that start at places, for windows of a size."""
    g, _ = _probe(size)
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.lit(size), F.slice(w, i, F.lit(g))).alias("h")))


def _probe_set(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(h, met): hashes of all g-grams in the windows."""
    w = F.split("gram", " ")
    all_ = [windows.filter(F.col("size") == n).select(F.explode(_grams(w, _positions(F.lit(n - _probe(n)[0] + 1)), n)).alias("p")) for n in sizes]
    found = all_[0]
    for more in all_[1:]:
        found = found.union(more)
    return found.select("p.h").distinct().withColumn("met", F.lit(True))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per row of docs (column text): the columns of keep, n_words, n_hit, item_ids, contaminated.

    item_ids is the sorted array of the items, as text, that have a window in the
    document. A null or empty text has no words and is clean; rows with equal or
    null ids are judged each by itself; an item without words, or with a null
    text, matches nothing; an item with a null id hits words but is not listed;
    an empty table on either side gives no rows, or clean ones. Columns may have
    any names.
    """
    windows = written(item_windows(benchmark, window), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most `window` of them
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    base = docs.select(kept, F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    nothing = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("h")))
    probes = [_grams(F.col("w"), _positions(F.size("w") - _probe(n)[0] + 1, _probe(n)[1]), n) for n in sizes]
    if not sizes:
        met = base.select("kept", "row", "w", F.lit(0).alias("at"), F.lit(0).alias("size"))
    elif small_enough(known := _probe_set(windows, sizes), SET_LIMIT):
        # Every document has a row at position 0, and one for each probe that is found.
        each = base.select("kept", "row", "w", F.explode(F.concat(nothing, *probes)).alias("p")).select("kept", "row", "w", "p.at", "p.size", "p.h")
        met = each.join(F.broadcast(known), "h", "left").filter("at = 0 OR met")
    else:
        base = written(base, "words")  # row numbers have to stay the same
        hits = base.select("row", F.explode(F.concat(*probes)).alias("p")).select("row", "p.at", "p.size", "p.h").join(known, "h").select("row", "at", "size")
        met = base.join(hits, "row", "left").withColumn("at", F.coalesce("at", F.lit(0)))
    # Where windows of a size may start, around a probe.
    low, high = F.greatest(F.lit(1), F.col("at") - F.floor(F.col("size") / 2).cast("int")), F.least(F.col("at"), F.size("w") - F.col("size") + 1)
    starts = F.when((F.col("at") > 0) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.slice("w", i, F.col("size"))).alias("gram")))
    found = met.select("kept", "row", F.size("w").cast("long").alias("n_words"), "size", F.explode_outer(grams).alias("x")).select("kept", "row", "n_words", "x.at", "size", "x.gram")
    # A value no window has keeps documents without a window from meeting in one task.
    found = found.withColumn("gram", F.coalesce("gram", F.concat(F.lit("\n"), F.col("row").cast("string"))))
    known = windows.select("gram", "item_id").withColumn("known", F.lit(True))
    known = F.broadcast(known) if small_enough(known, WINDOW_LIMIT) else known
    span = F.when(F.col("known"), F.struct("at", F.col("size").alias("n")))
    per_doc = found.join(known, "gram", "left").groupBy("kept", "row", "n_words").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("item_ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["at"] + x["n"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(a["upto"], x["at"]))).cast("long").alias("n")),
        lambda a: a["n"],
    )
    return per_doc.select("kept.*", "n_words", covered.alias("n_hit"), "item_ids").withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("a"), F.crc32(F.col("text").cast("binary")).alias("b"), F.length("text").alias("c")]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows. What a text is judged depends on the text alone, so rows go by its hashes."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.struct(*_text_key()).alias("key"))
    judged = contamination(docs.select("text", F.struct(*_text_key()).alias("key")), benchmark, keep=("key",))
    bad = written(judged.filter("contaminated").select("key").distinct(), "contaminated")
    bad = F.broadcast(bad) if small_enough(bad, BAD_LIMIT) else bad
    return keyed.join(bad, "key", "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
pos AS (SELECT rid, i AS p0, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS gram FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(w) - s.n + 2)) AS t(i)),
occ AS (SELECT pos.rid, pos.p0, pos.n, win.item_id FROM pos JOIN win ON pos.gram = win.gram AND pos.n = win.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM occ, unnest(range(p0, p0 + n)) AS t(p) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
