"""Queries over outlines: contents, headings, markers and uploads made from customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import chunking, outlines
from spandrel.plans.common import query, read

_CONTENTS = """b AS (SELECT c_custkey AS doc, CAST(c_custkey % 4 AS INTEGER) AS n, CAST(c_custkey % 3 + 1 AS INTEGER) AS m, CAST(c_custkey % 2 + 1 AS INTEGER) AS p FROM customer),
e AS (SELECT doc, 0 AS position, '1' AS number FROM b UNION ALL SELECT doc, i, CASE WHEN n > 0 THEN '1.' || CAST(i AS VARCHAR) END FROM b, range(1, m + 1) AS r(i)
UNION ALL SELECT doc, 10, '2' FROM b UNION ALL SELECT doc, 10 + i, '2.' || CAST(i AS VARCHAR) FROM b, range(1, n + 1) AS r(i)
UNION ALL SELECT doc, 20 + i, '2.' || CAST(n AS VARCHAR) || '.' || CAST(i AS VARCHAR) FROM b, range(1, 3) AS r(i) WHERE n > 0
UNION ALL SELECT doc, 30, '3' FROM b UNION ALL SELECT doc, 30 + i, CASE WHEN n > 0 THEN '3.' || CAST(i AS VARCHAR) END FROM b, range(1, p + 1) AS r(i))"""


@query(f"WITH {_CONTENTS} SELECT doc, CAST(position AS INTEGER) AS position, number FROM e")
def contents_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents whose second level is printed without numbers, with them where both neighbours agree."""
    k = F.col("c_custkey")
    n, m, p = (k % 4).cast("int"), (k % 3 + 1).cast("int"), (k % 2 + 1).cast("int")
    entry = lambda position, *number: F.struct(position.cast("int").alias("position"), (F.array(*number) if number else F.lit(None).cast("array<int>")).alias("number"))
    run = lambda count, start, number: F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), lambda i: entry(i + start, *number(i)))
    one = lambda position, number: F.array(entry(F.lit(position), F.lit(number)))
    blank = lambda i: ()
    deep = run(F.when(n > 0, 2).otherwise(0), 20, lambda i: (F.lit(2), n, i))
    every = F.concat(one(0, 1), run(m, 0, blank), one(10, 2), run(n, 10, blank), deep, one(30, 3), run(p, 30, blank))
    entries = read(spark, sf_dir, "customer").select(k.alias("doc"), F.explode(every).alias("e")).select("doc", "e.*")
    return outlines.infer_numbers(entries).withColumn("number", F.array_join("number", "."))


#: Lines of a document, and whether they are headings of its outline; #a and #b stand for numbers that hang on the document.
_LINES = (
    ("1 Inledning ..... 3", False), ("2 Krav ..... 4", False), ("#b Avslut ..... 9", False),
    ("1 Inledning", True), ("1.1 Syfte", True), ("1.2 Omfattning", True), ("4.1 Priser i annan bilaga.", False), ("2 Krav", True), ("17.00 Middag", False), ("2.1 Allmänt", True), ("2.1.1 Vite", True),
    ("2.1.1 Vite igen.", False), ("2.#a Leverans", True), ("300 Stolar", False), ("2.1 Åter allmänt.", False), ("#b Avslut", True), ("#b.1 Tvist,", False), ("#b.1 Tvist", True),
)


@query(
    "WITH l AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, (t, on) in enumerate(_LINES) if on)
    + """) AS v(position, line)), s AS (SELECT c_custkey AS doc, CAST(position AS BIGINT) AS position, replace(replace(line, '#a', CAST(c_custkey % 2 + 2 AS VARCHAR)), '#b', CAST(c_custkey % 3 + 3 AS VARCHAR)) AS line FROM customer, l)
SELECT doc, position, split_part(line, ' ', 1) AS number, substr(line, strpos(line, ' ') + 1) AS title, len(string_split(split_part(line, ' ', 1), '.')) AS level FROM s"""
)
def outline_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings among lines with repeated, quoted and impossible numbers."""
    k = F.col("c_custkey")
    lines = F.posexplode(F.array(*[F.lit(t) for t, _ in _LINES]))
    df = read(spark, sf_dir, "customer").select(k.alias("doc"), k, lines.alias("position", "text"))
    named = lambda mark, number: F.replace(F.col("text"), F.lit(mark), number.cast("string"))
    df = df.withColumn("text", named("#a", k % 2 + 2)).withColumn("text", named("#b", k % 3 + 3))
    return chunking.outline(df.select("doc", F.col("position").cast("long").alias("position"), "text"))


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS position, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 3 AS v, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT doc, position, CASE WHEN v = 0 AND n % 2 = 0 THEN '• Punkt' WHEN n % 2 = 0 THEN 'Punkt utan' WHEN n // 2 + 1 > 999 THEN 'Led ' || CAST(n // 2 + 1 AS VARCHAR) || '.' WHEN c > 2 THEN CAST(n // 2 + 1 AS VARCHAR) || '. Led' ELSE 'Led ' || CAST(n // 2 + 1 AS VARCHAR) || '.' END AS text FROM o""")
def markers_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items whose numbers or bullets were read at their ends; every other order of a customer is a numbered one."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("position"), n.alias("n"))
    number = F.concat(F.lit("Led "), F.floor(F.col("n") / 2 + 1).cast("string"), F.lit("."))
    text = F.when(F.col("n") % 2 == 1, number).when(F.col("position") % 3 == 0, "Punkt •").otherwise("Punkt utan")
    return outlines.markers_first(o.select("doc", "position", F.lit("list_item").alias("kind"), text.alias("text"))).select("doc", "position", "text")


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 5 AS INTEGER) AS n FROM orders),
s AS (SELECT k, n, unnest(range(1, n + 2)) AS i FROM o)
SELECT k AS file, CAST(i AS INTEGER) AS piece, CASE WHEN n = 0 THEN 'Avsnitt' ELSE 'Avsnitt (del ' || CAST(i AS VARCHAR) || ' av ' || CAST(n + 1 AS VARCHAR) || ')' END AS title, 'Del ' || CAST(i AS VARCHAR) || ' ' || repeat('x', 60) AS text, CAST(CASE WHEN i = 1 THEN 1 WHEN i >= 3 THEN 3 ELSE 2 END AS INTEGER) AS page FROM s""")
def uploads_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sections of uploads in pieces, each with the page that its first line is on."""
    k = F.col("o_orderkey")
    n = (k % 5).cast("int")
    line = lambda i: F.concat(F.lit("Del "), i.cast("string"), F.lit(" "), F.repeat(F.lit("x"), F.lit(60)))
    o = read(spark, sf_dir, "orders").select(k.alias("file"), F.transform(F.sequence(F.lit(1), n + 1), line).alias("lines"))
    sections = o.select("file", F.lit(0).alias("position"), F.lit("Avsnitt").alias("title"), F.array_join("lines", "\n").alias("text"), F.lit(1).alias("page_start"), F.lit(4).alias("page_end"))
    placed = o.select("file", F.posexplode("lines").alias("i", "text")).filter("i < 3").select("file", (F.col("i") + 1).cast("int").alias("page"), "text")
    return outlines.split_upload(sections, placed, 80).select("file", F.col("piece").cast("int").alias("piece"), "title", "text", F.col("page").cast("int").alias("page"))


@query()
def areas_guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names of nations that are cut, misspelt or longer may mean."""
    areas = read(spark, sf_dir, "nation").select(F.col("n_name").alias("area"))
    name, k = F.col("c_name"), F.col("c_custkey")
    said = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    spelt = F.when(k % 4 == 0, F.substring("n_name", 1, 3)).when(k % 4 == 1, F.concat("n_name", F.lit(" "), name)).when(k % 4 == 2, F.concat(F.substring("n_name", 2, 99), F.lit("x"))).otherwise(F.col("n_name"))
    return outlines.guess_areas(said.select(spelt.alias("asked")), areas)
