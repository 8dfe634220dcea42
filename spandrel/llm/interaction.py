"""How five quality filters interact, by a histogram of failure masks.

Native expressions give each document a mask of the filters that it fails. Four
of them look at the document alone; for the fifth, a grouping by whole text gives
the smallest identifier of every distinct text, and only identifiers are joined
back. What any order of the filters keeps and removes depends on the counts of
the 32 masks of a part alone, so that documents are counted once, and all orders
are worked out from the 32 cells.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import table

FILTERS = "ABCDE"
#: A: fewer words; B: a smaller share of distinct words, in per cent; C: a larger share of capitals, in per cent; D: any of these characters.
WORDS, DISTINCT, CAPITALS, SPECIAL = 50, 65, 5, r"[#$%&*|]"
CELLS = 2 ** len(FILTERS)
#: White space of the contract, but for the blank.
_SPACE = "\t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def own_mask(text: Column) -> Column:
    """The bits of A to D that a text fails; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, _SPACE, " " * len(_SPACE)), " "), "")
    # A function of one argument names the words once, so that texts are split once.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    flags = F.transform(
        F.array(counts),
        lambda c: F.when(c["all"] < WORDS, _bit("A")).otherwise(0) + F.when(100 * c["distinct"] < DISTINCT * c["all"], _bit("B")).otherwise(0),
    )[0]
    return (flags + F.when(100 * capitals.cast("long") > CAPITALS * F.length(text), _bit("C")).otherwise(0) + F.when(text.rlike(SPECIAL), _bit("D")).otherwise(0)).cast("int")


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic): one row per document; a document without labels is neither good nor toxic.

    E is failed if a smaller doc_id has the same text; a null doc_id is smaller
    than none and none is smaller than it. A doc_id that occurs again counts by
    itself in every row, and labels that occur again count as one.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.xxhash64(text, F.length(text))
    docs = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), own_mask(F.col("text")).alias("own"), digest.alias("digest"))
    # One row per text: its first document, known by its identifier and, as identifiers may repeat, a digest.
    first = documents.select("doc_id", text.alias("text")).groupBy("text").agg(F.min("doc_id").alias("first")).filter("first IS NOT NULL").select("first", digest.alias("mark"))
    marked = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    met = docs.join(first, (F.col("id") == F.col("first")) & (F.col("digest") == F.col("mark")), "left").join(marked, F.col("id") == F.col("labelled"), "left")
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    return met.select("part", (F.col("own") + F.when(repeated, _bit("E")).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("toxic"))


def histogram(masked: DataFrame) -> DataFrame:
    """(part, n, good, toxic): per part three arrays of 32 counts, by mask."""
    cells = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = lambda name: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)).cast("long") for m in range(CELLS)])
    return cells.groupBy("part").agg(*[counts(c).alias(c) for c in ("n", "good", "toxic")])


def _steps() -> str:
    """The steps of all orders as an array of (filter_order, step, before, bit)."""
    rows = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for k, name in enumerate(order, 1):
            rows.append(f"struct('{order}' AS filter_order, {k} AS step, {before} AS before, {_bit(name)} AS bit)")
            before += _bit(name)
    return f"array({', '.join(rows)})"


def orders(cells: DataFrame) -> DataFrame:
    """One row per part, order and step, from the cells of histogram()."""
    each = cells.withColumn("s", F.explode(F.expr(_steps()))).select("part", "n", "good", "toxic", "s.*")
    masks_ = F.sequence(F.lit(0), F.lit(CELLS - 1))
    bit, before = F.col("bit"), F.col("before")
    # A document is taken by the first of its filters: of k filters each is first in 1/k of all orders.
    every = factorial(len(FILTERS))

    def total(name: str, holds, weight=lambda m: F.lit(1)) -> Column:
        worth = F.zip_with(masks_, F.col(name), lambda m, n: F.when(holds(m), n * weight(m)).otherwise(0).cast("long"))
        return F.aggregate(worth, F.lit(0).cast("long"), lambda a, x: a + x)

    has = lambda m: m.bitwiseAND(bit) != 0
    late = lambda m: m.bitwiseAND(before) != 0
    return each.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", lambda m: has(m) & ~late(m)).alias("removed"),
        total("n", lambda m: has(m) & late(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: has(m) & ~late(m)).alias("good_lost"),
        total("toxic", lambda m: has(m) & ~late(m)).alias("toxic_lost"),
        total("n", has, lambda m: F.lit(every) / F.greatest(F.bit_count(m), F.lit(1))).alias("shapley"),
    )


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: documents kept, removed, redundant, failing this filter alone, good and toxic ones lost, and the filter's share.

    Null texts and null sources count as empty ones. An empty table of documents
    has no parts and gives no rows; one of labels gives no losses. A text of any
    length is one value; texts that very many documents share meet as one row
    per task. Columns other than those named are not looked at.
    """
    return orders(histogram(masks(documents, labels)))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(w) < {WORDS} THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT} * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {CAPITALS} * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '{SPECIAL}') THEN 8 ELSE 0 END) + (CASE WHEN d.doc_id > first THEN 16 ELSE 0 END) AS mask
  FROM d JOIN f USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS b(name, bit)),
o AS (SELECT v.name || w.name || x.name || y.name || z.name AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits FROM b v, b w, b x, b y, b z
  WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS before FROM o, range(1, 6) AS r(k)),
p AS (SELECT h.part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, s GROUP BY h.part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM p
"""
