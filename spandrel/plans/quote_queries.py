"""Queries over quotes and their pages, and over a store of parsed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import quotes
from spandrel.plans.common import query, read
from spandrel.sources import parsed

_PAGES = """o AS (SELECT o_orderkey AS doc, CAST(o_orderkey % 3 + 1 AS INTEGER) AS n FROM orders),
p AS (SELECT doc, n, i AS page, 'Sida ' || i || ' av order ' || doc || chr(10) || 'Beloppet är 10–20 kr för order ' || doc || ' på sida ' || i || '.' AS text FROM (SELECT *, unnest([1, 2, 3]) AS i FROM o))"""


@query(f"""WITH {_PAGES}, q AS (SELECT *, CASE WHEN doc % 7 = 0 THEN 0 WHEN doc % 4 = 0 THEN 1 ELSE 2 END AS v FROM p)
SELECT doc, CAST(found_on AS INTEGER) AS found_on, match, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end" FROM (
SELECT doc, 1 AS found_on, 'none' AS match, -1 AS "start", -1 AS "end" FROM q WHERE v = 0 AND page = 1
UNION ALL SELECT doc, 1, 'partial', strpos(text, 'Beloppet') - 1, length(text) FROM q WHERE v = 1 AND page = 1
UNION ALL SELECT doc, n, 'full', strpos(text, 'Beloppet') - 1, length(text) FROM q WHERE v = 2 AND page = n)""")
def quotes_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes in other dashes and white space, on the cited page or after it, over a page break, or nowhere."""
    k = F.col("o_orderkey")
    doc = k.cast("string")
    text = lambda i: F.concat(F.lit("Sida "), i.cast("string"), F.lit(" av order "), doc, F.lit("\nBeloppet är 10–20 kr för order "), doc, F.lit(" på sida "), i.cast("string"), F.lit("."))
    o = read(spark, sf_dir, "orders")
    pages = o.select(k.alias("doc"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("page"), k).select("doc", "page", text(F.col("page")).alias("text"))
    said = lambda i: F.concat(F.lit("Beloppet  är\n10-20 kr för order "), doc, F.lit(" på sida "), i.cast("string"), F.lit("."))
    over = F.concat(said(F.lit(1)), F.lit(" Sida 2 av"))
    quote = F.when(k % 7 == 0, F.lit("Det finns inte någonstans i texten alls")).when(k % 4 == 0, over).otherwise(said((k % 3 + 1).cast("int")))
    return quotes.locate(o.select(k.alias("doc"), quote.alias("quote"), F.lit(1).alias("page")), pages).select("doc", "found_on", "match", "start", "end")


@query("""SELECT doc_id AS sha256, CASE WHEN doc_id % 3 = 0 THEN 'cached' WHEN text IS NULL OR text = '' THEN 'failed' ELSE 'parsed' END AS status, CAST(CASE WHEN doc_id % 3 = 0 THEN -1 WHEN text IS NULL OR text = '' THEN -2 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS lines FROM documents""")
def files_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read by the second version of a parser, whose store has a third of them; the first version's results don't count."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sha256"), "text")
    store = docs.filter("sha256 % 3 < 2").select("sha256", F.lit(-1).alias("lines"), F.when(F.col("sha256") % 3 == 0, "v2").otherwise("v1").alias("parser"))

    def lines(fresh: DataFrame) -> DataFrame:
        return fresh.select("sha256", F.when(F.coalesce("text", F.lit("")) == "", "empty").alias("error"), F.size(F.split("text", "\n")).alias("lines"))

    found = parsed.parse_new(docs, store, "v2", lines)
    return found.select("sha256", "status", F.when(F.col("status") == parsed.FAILED, -2).otherwise(F.col("lines")).alias("lines"))
