"""Queries of the lookups and of recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import runs, tools
from spandrel.plans.calendars import _DAYS, days
from spandrel.plans.common import query, read


@query("""WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS sha256, c_name AS title, CASE c_mktsegment WHEN 'BUILDING' THEN 'agreement' WHEN 'MACHINERY' THEN 'procurement' ELSE 'support' END AS document_group FROM customer),
s AS (SELECT CAST(o_custkey AS VARCHAR) AS sha256, count(*) AS sections FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), j AS (SELECT * FROM f JOIN s USING (sha256))
SELECT *, (SELECT count(*) FROM j) AS total FROM j ORDER BY CASE document_group WHEN 'agreement' THEN 0 WHEN 'procurement' THEN 1 ELSE 2 END, title, sha256 LIMIT 50 OFFSET 25""")
def documents_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of files by group and title, with their visible sections and the total."""
    group = F.when(F.col("c_mktsegment") == "BUILDING", "agreement").when(F.col("c_mktsegment") == "MACHINERY", "procurement").otherwise("support")
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sha256"), F.col("c_name").alias("title"), group.alias("document_group"))
    sections = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").cast("string").alias("sha256"))
    return tools.list_documents(files, sections, 50, 25)


@query("""WITH r AS (SELECT o_orderkey AS id FROM orders), t AS (SELECT l_orderkey AS id, l_linenumber AS place, CAST(l_suppkey AS VARCHAR) AS f, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_partkey AS BIGINT) END AS p FROM lineitem WHERE l_linenumber > 2),
v AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS f, CAST(l_partkey AS BIGINT) AS p FROM lineitem WHERE l_suppkey % 2 = 0 AND l_partkey % 5 > 0),
j AS (SELECT t.*, CASE WHEN t.p IS NULL THEN t.f IN (SELECT f FROM v) ELSE (t.f, t.p) IN (SELECT f, p FROM v) END AS can FROM t),
g AS (SELECT id, count(*) FILTER (WHERE can) AS shown, count(*) FILTER (WHERE NOT can) AS held FROM j GROUP BY id)
SELECT r.id AS reference_id, CAST(coalesce(shown, 0) AS BIGINT) AS shown, CAST(coalesce(held, 0) AS BIGINT) AS held_back FROM r LEFT JOIN g ON g.id = r.id""")
def references_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many targets of each reference can be shown, and how many are held back."""
    line = read(spark, sf_dir, "lineitem")
    file, part = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("long")
    targets = line.filter("l_linenumber > 2").select(F.col("l_orderkey").alias("reference_id"), F.col("l_linenumber").cast("int").alias("place"), file.alias("target_sha256"), F.when(F.col("l_linenumber") % 3 > 0, part).alias("target_section_position"))
    visible = line.filter("l_suppkey % 2 = 0 AND l_partkey % 5 > 0").select(file.alias("sha256"), part.alias("section_position"))
    found = tools.section_references(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference_id")), targets, visible)
    return found.select("reference_id", F.size("shown").cast("long").alias("shown"), F.col("held_back").cast("long").alias("held_back"))


@query(f"""WITH {_DAYS}, w AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM cal WHERE working),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderkey % 29 + 1 AS INTEGER) AS amount FROM orders),
b AS (SELECT o.*, (SELECT max(n) FROM w WHERE w.day <= o.start) AS upto FROM o)
SELECT o_orderkey, w.day AS result, CAST(isodow(w.day) AS INTEGER) AS weekday FROM b JOIN w ON w.n = upto + amount""", dates=("result",))
def dates_calculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates some working days on, and their weekdays."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), (F.col("o_orderkey") % 29 + 1).cast("int").alias("amount"), F.lit("working_days").alias("unit"))
    return tools.calculate_date(o, "start", "amount", "unit", days(spark)).select("o_orderkey", "result", F.col("weekday").cast("int").alias("weekday"))


@query("""WITH d AS (SELECT DISTINCT o_custkey AS f, o_orderkey % 40 AS p FROM orders), i AS (SELECT *, p - row_number() OVER (PARTITION BY f ORDER BY p) AS g FROM d),
r AS (SELECT f, g, min(p) AS a, max(p) AS b FROM i GROUP BY ALL)
SELECT f AS file, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END, ', ' ORDER BY a) AS pages FROM r GROUP BY f""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each file as ranges."""
    p = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 40).alias("page"))
    return tools.page_list(p, "file", "page")


@query("""WITH n AS (SELECT DISTINCT o_custkey AS doc, CAST(o_orderkey % 3 + 1 AS INTEGER) AS a, CAST(o_orderkey % 7 + 1 AS INTEGER) AS b FROM orders),
g AS (SELECT DISTINCT doc, a, b - 1 AS b FROM n WHERE b > 1), m AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc = g.doc AND n.a = g.a AND n.b = g.b))
SELECT doc, CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) AS number FROM m WHERE b > 1 AND EXISTS (SELECT 1 FROM n WHERE n.doc = m.doc AND n.a = m.a AND n.b = m.b - 1)""")
def outline_number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers that are missing between two others."""
    number = F.concat_ws(".", (F.col("o_orderkey") % 3 + 1).cast("string"), (F.col("o_orderkey") % 7 + 1).cast("string"))
    return tools.outline_gaps(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), number.alias("number")).distinct())


@query("""WITH e AS (SELECT event_id, user_id AS run, event_id AS place, CAST(floor(value) AS INTEGER) % 5 AS key, event_type FROM events),
c AS (SELECT run, place, key FROM e WHERE event_type = 'purchase'), r AS (SELECT run, place, key, CASE event_type WHEN 'click' THEN 'reference' WHEN 'view' THEN 'search' ELSE 'amendment' END AS kind FROM e WHERE event_type <> 'purchase'),
m AS (SELECT c.run, c.place, c.key, min(CASE kind WHEN 'reference' THEN 0 WHEN 'amendment' THEN 1 WHEN 'search' THEN 2 END) AS k FROM c LEFT JOIN r ON r.run = c.run AND r.key = c.key AND r.place < c.place GROUP BY ALL)
SELECT run, place, key, CASE k WHEN 0 THEN 'reference' WHEN 1 THEN 'amendment' WHEN 2 THEN 'search' ELSE 'none' END AS found_by FROM m""")
def steps_found_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What led to each section that a run read."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("place"), (F.floor("value").cast("int") % 5).alias("key"), "event_type")
    kind = F.when(F.col("event_type") == "click", "reference").when(F.col("event_type") == "view", "search").otherwise("amendment")
    return runs.read_steps(e.filter("event_type = 'purchase'").select("run", "place", "key"), e.filter("event_type <> 'purchase'").select("run", "place", "key", kind.alias("kind")))


@query("SELECT event_type AS tool, count(*) AS calls, count(DISTINCT user_id) AS questions FROM events GROUP BY 1")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tool was called, and in how many questions."""
    return runs.tool_use(read(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.col("user_id").alias("question")))


@query("""SELECT CAST(count(*) FILTER (WHERE a AND s) AS BIGINT) AS "right", CAST(count(*) FILTER (WHERE a AND NOT s) AS BIGINT) AS needless, CAST(count(*) FILTER (WHERE NOT a AND s) AS BIGINT) AS missed, CAST(count(*) FILTER (WHERE NOT a AND NOT s) AS BIGINT) AS silent
FROM (SELECT c_custkey % 3 = 0 AS a, c_custkey % 5 < 2 AS s FROM customer)""")
def asks_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked back against those that should have been."""
    return runs.asks(read(spark, sf_dir, "customer").select((F.col("c_custkey") % 3 == 0).alias("asked"), (F.col("c_custkey") % 5 < 2).alias("should_ask")))


@query("""SELECT o_custkey AS draft, bool_and(o_orderstatus <> 'F') AS passed, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS problems FROM orders GROUP BY 1""")
def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every review of a draft passed, and the notes of those that didn't."""
    verdict = F.when(F.col("o_orderstatus") == "F", "fail").otherwise("ok")
    found = runs.verdicts(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft"), verdict.alias("verdict"), F.col("o_orderpriority").alias("note")))
    return found.select("draft", "passed", F.size("problems").cast("long").alias("problems"))


@query("""WITH u AS (SELECT user_id % 10 AS thread, CAST(event_id % 25 AS VARCHAR) AS sha256, epoch_us(ts) AS t, CAST(event_id % 90 + 10 AS BIGINT) AS size, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'),
o AS (SELECT thread, sha256, min((t, size)) AS x FROM u GROUP BY ALL), p AS (SELECT thread, sha256, row_number() OVER w AS place, sum(x[2]) OVER w AS total FROM o WINDOW w AS (PARTITION BY thread ORDER BY x[1] DESC, sha256 ROWS UNBOUNDED PRECEDING))
SELECT thread, sha256 FROM p WHERE place <= 8 AND total <= 400""")
def uploads_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that neither expire nor exceed their thread's limits."""
    u = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("thread"), (F.col("event_id") % 25).cast("string").alias("sha256"), F.col("ts").alias("created"), (F.col("event_id") % 90 + 10).alias("size"))
    return runs.stored_uploads(u, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), "10 DAYS", 8, 400).select("thread", "sha256")
