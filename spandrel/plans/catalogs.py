"""Queries of the catalogue, of reports, and of checks: pages made from suppliers, files from customers, links from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import dates, text
from spandrel.functions.lineage import cut
from spandrel.operators import catalog, chunking, periods, reports, runs, tools, validation
from spandrel.plans import registers
from spandrel.plans.common import query, read, spread
from spandrel.plans.registers import _ROWS, _TABLES
from spandrel.sources import pages

_LINKS = """
links AS (SELECT o_orderkey % 60 + 1 AS page_id, o_custkey AS sha256, o_orderpriority AS title FROM orders),
pages_ AS (SELECT s_suppkey AS page_id, 'P-' || CAST(s_nationkey AS VARCHAR) AS procurement_number, CASE WHEN s_suppkey % 4 > 0 THEN 'A-' || CAST(s_suppkey % 8 AS VARCHAR) END AS agreement_number FROM supplier),
docs AS (SELECT c_custkey AS sha256, lower(c_mktsegment) AS file_type FROM customer WHERE c_custkey % 5 > 0),
catalog AS (SELECT * FROM links JOIN pages_ USING (page_id) JOIN docs USING (sha256)),
areas AS (SELECT 'P-' || CAST(n_nationkey % 20 AS VARCHAR) AS procurement_number, r_name AS framework_area FROM nation JOIN region ON n_regionkey = r_regionkey),
suppliers AS (SELECT 'A-' || CAST(s_suppkey AS VARCHAR) AS agreement_number, s_name AS supplier_name FROM supplier WHERE s_suppkey < 7)"""


def _s(c) -> F.Column:
    return c.cast("string")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("s_suppkey")
    links = o.select((F.col("o_orderkey") % 60 + 1).alias("page_id"), F.col("o_custkey").alias("sha256"), F.col("o_orderpriority").alias("title"))
    pages = read(spark, sf_dir, "supplier").select(k.alias("page_id"), F.concat(F.lit("P-"), _s(F.col("s_nationkey"))).alias("procurement_number"), F.when(k % 4 > 0, F.concat(F.lit("A-"), _s(k % 8))).alias("agreement_number"))
    docs = read(spark, sf_dir, "customer").filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("sha256"), F.lower("c_mktsegment").alias("file_type"))
    return catalog.catalog_links(links, pages, docs)


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat(F.lit("P-"), _s(F.col("n_nationkey") % 20)).alias("procurement_number"), F.col("r_name").alias("framework_area"))


@query(f"WITH {_LINKS} SELECT * FROM catalog")
def catalog_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with their pages and files."""
    return _catalog(spark, sf_dir)


@query(f"""WITH {_LINKS}, a AS (SELECT procurement_number, array_to_string(list_sort(list(DISTINCT framework_area)), '|') AS framework_areas FROM areas GROUP BY 1)
SELECT page_id, sha256, title, coalesce(framework_areas, '') AS framework_areas, supplier_name FROM catalog LEFT JOIN a USING (procurement_number) LEFT JOIN suppliers USING (agreement_number)""")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the areas of their procurements and their suppliers' names."""
    suppliers = read(spark, sf_dir, "supplier").filter("s_suppkey < 7").select(F.concat(F.lit("A-"), _s(F.col("s_suppkey"))).alias("agreement_number"), F.col("s_name").alias("supplier_name"))
    found = catalog.document_links(_catalog(spark, sf_dir), _areas(spark, sf_dir), suppliers)
    return found.select("page_id", "sha256", "title", F.array_join("framework_areas", "|").alias("framework_areas"), "supplier_name")


@query(f"""WITH {_LINKS}, l AS (SELECT sha256, list_sort(list(DISTINCT procurement_number)) AS p, list_sort(list(DISTINCT agreement_number) FILTER (WHERE agreement_number IS NOT NULL)) AS a, list_sort(list(DISTINCT title)) AS t FROM catalog GROUP BY 1),
f AS (SELECT sha256, list_sort(list(DISTINCT framework_area)) AS f FROM catalog JOIN areas USING (procurement_number) GROUP BY 1)
SELECT sha256, array_to_string(p, '|') AS procurement_numbers, coalesce(array_to_string(a, '|'), '') AS agreement_numbers, array_to_string(t, '|') AS titles, coalesce(array_to_string(f, '|'), '') AS framework_areas FROM l LEFT JOIN f USING (sha256)""")
def document_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file its areas, numbers and titles."""
    found = catalog.document_scopes(_catalog(spark, sf_dir), _areas(spark, sf_dir))
    return found.select("sha256", *[F.array_join(c, "|").alias(c) for c in ("procurement_numbers", "agreement_numbers", "titles", "framework_areas")])


@query(f"""WITH {_TABLES} SELECT agreement_number, framework_area, path, a.supplier_name, former_name FROM agreements a JOIN links USING (agreement_number) LEFT JOIN supplier_names s ON s.org_number = a.org_number AND s.name = a.supplier_name""")
def register_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements in sub-areas with their suppliers' former names."""
    return catalog.register_entries(registers.tables(spark, sf_dir)).select("agreement_number", "framework_area", "path", "supplier_name", "former_name")


@query(f"""WITH {_ROWS}, p AS (SELECT DISTINCT procurement_number, 'zone ' || CAST(length(procurement_number) % 3 AS VARCHAR) AS title FROM rows_)
SELECT DISTINCT procurement_number AS page_id, agreement_number FROM p JOIN rows_ USING (procurement_number) WHERE len(list_filter(sub_area_path, lambda x: lower(x) = lower(title))) > 0""")
def page_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements in the sub-area that a procurement's page is named after."""
    # Pages are made from the rows that they meet, so rows are read once.
    rows = cut(registers.rows(spark, sf_dir).select("agreement_number", "procurement_number", "sub_area_path"))
    pages = rows.select("procurement_number").distinct().select(F.col("procurement_number").alias("page_id"), F.concat(F.lit("zone "), _s(F.length("procurement_number") % 3)).alias("title"), "procurement_number")
    return catalog.page_scope(pages, rows)


@query(f"WITH {_ROWS} SELECT DISTINCT framework_area, procurement_number FROM rows_ WHERE framework_area IN ('ASIA', 'EUROPE')")
def procurements_of_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.procurements_for_areas(registers.rows(spark, sf_dir), ["Asia ", "europe"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, o_custkey % 7 + 1 FROM orders WHERE o_custkey % 10 = 3)")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a list of compound keys."""
    keys = read(spark, sf_dir, "orders").filter("o_custkey % 10 = 3").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"))
    return catalog.lookup(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), keys, ["l_orderkey", "l_linenumber"])


@query("""WITH f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '23.3-' || CAST(c_custkey % 40 AS VARCHAR) || '-2021' WHEN c_custkey % 3 = 1 THEN '23.3.0' || CAST(c_custkey % 40 + 100 AS VARCHAR) || '-21:07' ELSE 'other' END AS value FROM customer)
SELECT id, value, CASE WHEN id % 3 = 0 AND id % 40 >= 10 AND id % 40 < 30 THEN '23.3.' || CAST(id % 40 AS VARCHAR) || '-21' WHEN id % 3 = 1 AND id % 40 < 20 THEN '23.3-' || CAST(id % 40 + 100 AS VARCHAR) || '-21-007' ELSE value END AS spelling FROM f""")
def numbers_respelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of texts as the register writes them."""
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, F.concat(F.lit("23.3-"), _s(k % 40), F.lit("-2021"))).when(k % 3 == 1, F.concat(F.lit("23.3.0"), _s(k % 40 + 100), F.lit("-21:07"))).otherwise("other")
    facts = read(spark, sf_dir, "customer").select(k.alias("id"), value.alias("value"))
    procurements = spark.range(10, 30).select(F.concat(F.lit("23.3."), _s(F.col("id")), F.lit("-21")).alias("procurement_number"))
    agreements = spark.range(100, 120).select(F.concat(F.lit("23.3-"), _s(F.col("id")), F.lit("-21-007")).alias("agreement_number"))
    return catalog.respell(facts, procurements, agreements)


@query("""WITH b AS (SELECT item_id, text FROM benchmark), alt AS (SELECT item_id AS question, source_id, item_id % 40 AS sha256, CASE source_id WHEN 1 THEN substr(text, 3, 40) WHEN 2 THEN 'no such words' ELSE substr(text, 1, 1) END AS quote FROM b, (VALUES (1), (2), (3)) t(source_id)),
s AS (SELECT item_id % 40 AS sha256, item_id AS position, text FROM benchmark), m AS (SELECT question, source_id, alt.sha256, quote, count(*) FILTER (WHERE contains(text, quote)) AS found, min(CAST(position AS VARCHAR)) FILTER (WHERE contains(text, quote)) AS first FROM alt LEFT JOIN s ON s.sha256 = alt.sha256 GROUP BY ALL)
SELECT question, source_id, sha256, quote, found, CASE WHEN found = 1 THEN CAST(first AS VARCHAR) END AS position FROM m""")
def gold_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that holds each quote of an evaluation set, if there is just one."""
    b, i = read(spark, sf_dir, "benchmark"), F.col("item_id")
    quote = F.when(F.col("source_id") == 1, F.substring("text", 3, 40)).when(F.col("source_id") == 2, "no such words").otherwise(F.substring("text", 1, 1))
    alternatives = b.withColumn("source_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(i.alias("question"), "source_id", (i % 40).alias("sha256"), quote.alias("quote"))
    return catalog.gold_sources(alternatives, b.select((i % 40).alias("sha256"), _s(i).alias("position"), "text"))


_RUNS = "r AS (SELECT event_id % 50 AS question, user_id % 2 AS run, max(event_type) AS verdict, max(value) AS seconds FROM events GROUP BY ALL)"


@query(f"""WITH {_RUNS}, j AS (SELECT a.question, a.verdict AS va, b.verdict AS vb, a.seconds AS sa, b.seconds AS sb FROM r a JOIN r b ON a.question = b.question AND a.run = 0 AND b.run = 1)
SELECT question, CASE va WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 0.5 ELSE 0.0 END AS score, CASE vb WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 0.5 ELSE 0.0 END AS score_b, round(sb - sa, 6) AS slower FROM j""")
def runs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' verdicts and times on the same questions."""
    e = read(spark, sf_dir, "events")
    r = e.groupBy((F.col("event_id") % 50).alias("question"), (F.col("user_id") % 2).alias("run")).agg(F.max("event_type").alias("verdict"), F.max("value").alias("seconds"))
    run = lambda n: r.filter(F.col("run") == n).drop("run")
    pairs = catalog.paired_runs(run(0), run(1))
    score = lambda c: catalog.verdict_score(F.when(F.col(c) == "view", "correct").when(F.col(c) == "purchase", "partial")).cast("double")
    return pairs.select("question", score("verdict").alias("score"), score("verdict_b").alias("score_b"), F.round(F.col("seconds_b") - F.col("seconds"), 6).alias("slower"))


@query("""WITH t AS (SELECT c_custkey AS draft, c_custkey % 4 AS a, c_custkey % 3 AS b FROM customer), s AS (SELECT draft, list_distinct([a, b]) AS r, list_distinct([b, 5]) AS d FROM t)
SELECT draft, CAST(len(list_filter(r, lambda x: list_contains(d, x))) AS INTEGER) AS hits, CAST(len(list_filter(r, lambda x: NOT list_contains(d, x))) AS INTEGER) AS misses, CAST(len(list_filter(d, lambda x: NOT list_contains(r, x))) AS INTEGER) AS extra FROM s""")
def agreements_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many agreements of a draft are right, missing and too many, however they are written."""
    k = F.col("c_custkey")
    long, short = lambda x: F.concat(F.lit("23.3-10"), _s(x), F.lit("-2021-001")), lambda x: F.concat(F.lit("23.3.10"), _s(x), F.lit("-21:01"))
    drafts = spread(read(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("draft"), F.array(long(k % 4), short(k % 3)).alias("required"), F.array(long(k % 3), short(F.lit(5)), F.lit("none")).alias("declared"))
    return catalog.claimed_agreements(drafts).drop("required", "declared")


@query("SELECT DISTINCT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def index_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored and isn't in a new build."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"), "o_orderkey")
    return catalog.removed(o.filter("o_orderkey % 2 = 0").drop("o_orderkey"), o.filter("o_orderkey % 2 = 1").drop("o_orderkey"))


@query("""WITH r AS (SELECT event_type AS system, user_id AS question, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank, event_id AS chunk FROM events WHERE event_type IN ('view', 'click')) SELECT * FROM r WHERE rank <= 3""")
def stored_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankings of several systems in one table."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    of = lambda kind: e.filter(F.col("event_type") == kind).withColumn("rank", rank).filter("rank <= 3").select(F.col("user_id").alias("question"), "rank", F.col("event_id").alias("chunk"))
    return catalog.rankings({"view": of("view"), "click": of("click")})


@query("""WITH f AS (SELECT DISTINCT '23.3-' || CAST(c_custkey % 30 + 100 AS VARCHAR) || '-2021-001' AS agreement, c_mktsegment AS field, c_nationkey % 3 AS value FROM customer)
SELECT agreement, count(*) AS facts, min(field || '=' || CAST(value AS VARCHAR)) AS first FROM f GROUP BY 1""")
def facts_by_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register facts grouped under one spelling of their agreement."""
    k = F.col("c_custkey")
    number = F.when(k % 2 == 0, F.concat(F.lit("23.3-"), _s(k % 30 + 100), F.lit("-2021-001"))).otherwise(F.concat(F.lit("23.3.0"), _s(k % 30 + 100), F.lit("-21:01")))
    facts = read(spark, sf_dir, "customer").select(number.alias("agreement_number"), F.col("c_mktsegment").alias("field"), _s(F.col("c_nationkey") % 3).alias("value"))
    return catalog.by_agreement(facts).select("agreement", F.size("facts").cast("long").alias("facts"), F.concat_ws("=", F.col("facts")[0]["field"], F.col("facts")[0]["value"]).alias("first"))


# Reports

_FILES = """f AS (SELECT c_custkey AS sha256, lower(c_mktsegment) AS file_type, CASE WHEN c_nationkey % 6 > 0 THEN 'type ' || CAST(c_nationkey % 6 AS VARCHAR) END AS document_type, 'R' || CAST(c_custkey % 3 AS VARCHAR) AS type_rule, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 70 END AS pages,
  c_custkey % 50 = 0 AS is_template, c_custkey % 40 = 0 AS needs_ocr, c_custkey % 30 AS links FROM customer)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("sha256"), F.lower("c_mktsegment").alias("file_type"), F.when(n % 6 > 0, F.concat(F.lit("type "), _s(n % 6))).alias("document_type"), F.concat(F.lit("R"), _s(k % 3)).alias("type_rule"),
        F.when(k % 9 > 0, k % 70).alias("pages"), (k % 50 == 0).alias("is_template"), (k % 40 == 0).alias("needs_ocr"), (k % 30).alias("links"),
    )


@query(f"""WITH {_FILES} SELECT 'document_type' AS section, coalesce(document_type, 'none') AS item, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'file_type', file_type, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'type_rule', concat_ws(' ', document_type, type_rule), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'pages', 'all', CAST(sum(coalesce(pages, 0)) AS BIGINT) FROM f
UNION ALL SELECT 'template', CAST(sha256 AS VARCHAR), 1 FROM f WHERE is_template UNION ALL SELECT 'needs_ocr', CAST(sha256 AS VARCHAR), 1 FROM f WHERE needs_ocr UNION ALL SELECT 'unlinked', CAST(sha256 AS VARCHAR), 1 FROM f WHERE links = 0""")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.documents(_files(spark, sf_dir))


@query("""WITH f AS (SELECT c_custkey % 20 AS sections, c_custkey % 90 AS chunks, 'kind ' || CAST(c_custkey % 4 AS VARCHAR) AS outline, c_custkey % 11 = 0 AS gap FROM customer)
SELECT 'sections' AS section, 'all' AS item, CAST(sum(sections) AS BIGINT) AS n FROM f UNION ALL SELECT 'chunks', 'all', CAST(sum(chunks) AS BIGINT) FROM f UNION ALL SELECT 'outline', outline, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'toc_gaps', 'all', count(*) FROM f WHERE gap""")
def report_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return reports.outlines(read(spark, sf_dir, "customer").select((k % 20).alias("sections"), (k % 90).alias("chunks"), F.concat(F.lit("kind "), _s(k % 4)).alias("outline"), F.when(k % 11 == 0, 2).otherwise(0).alias("toc_gaps")))


@query("""WITH n AS (SELECT DISTINCT o_custkey AS f, o_orderkey % 10 AS s FROM orders), g AS (SELECT o_custkey AS f, o_orderkey % 10 AS s, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) AS lvl FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL),
w AS (SELECT n.f, max(coalesce(lvl, 0)) AS lvl FROM n LEFT JOIN g ON g.f = n.f AND g.s = n.s GROUP BY 1)
SELECT CASE lvl WHEN 0 THEN 'matched' WHEN 1 THEN 'note' WHEN 2 THEN 'report' ELSE 'quarantine' END AS status, count(*) AS files FROM w GROUP BY 1""")
def report_register_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the worst finding on their numbers."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha256"), (F.col("o_orderkey") % 10).alias("subject"), "o_orderkey", "o_orderpriority")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "quarantine").when(F.col("o_orderpriority") == "2-HIGH", "report").otherwise("note")
    return reports.register_match(o.select("sha256", "subject").distinct(), o.filter("o_orderkey % 4 = 0").select("sha256", "subject", severity.alias("severity")))


@query("""WITH a AS (SELECT c_mktsegment AS framework_area, c_custkey % 5 < 2 AS cov, c_custkey % 2 = 0 AS card, c_custkey % 3 = 0 AS main, c_custkey % 5 AS s FROM customer)
SELECT framework_area, count(*) FILTER (WHERE cov AND card AND NOT main) AS card_only, count(*) FILTER (WHERE cov AND NOT card AND main) AS main_only, count(*) FILTER (WHERE cov AND card AND main) AS both,
count(*) FILTER (WHERE s = 2) AS procurement_version, count(*) FILTER (WHERE s = 3) AS held_back, count(*) FILTER (WHERE s = 4) AS not_covered FROM a GROUP BY 1""")
def report_area_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 5 < 2, "covered").when(k % 5 == 2, "procurement_version").when(k % 5 == 3, "held_back").otherwise("not_covered")
    return reports.area_coverage(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("framework_area"), status.alias("status"), (k % 2 == 0).alias("has_card"), (k % 3 == 0).alias("has_main")))


@query("""WITH r AS (SELECT l_returnflag AS kind, CASE WHEN l_linenumber > 2 THEN 'R' || CAST(l_linenumber AS VARCHAR) ELSE 'none' END AS rule, l_linestatus AS status FROM lineitem), t AS (SELECT kind, rule, status, count(*) AS n FROM r GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY kind), 6) AS share FROM t""")
def report_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("l_linenumber") > 2, F.concat(F.lit("R"), _s(F.col("l_linenumber"))))
    return reports.references(read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), rule.alias("rule"), F.col("l_linestatus").alias("status")))


_FOUND = """g AS (SELECT o_orderpriority AS "check", CASE o_orderstatus WHEN 'F' THEN 'quarantine' ELSE 'note' END AS severity, o_custkey AS sha256, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END AS section_position, CASE WHEN o_orderkey % 6 = 0 THEN 'seen' END AS accepted_reason FROM orders)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("check"), F.when(F.col("o_orderstatus") == "F", "quarantine").otherwise("note").alias("severity"), F.col("o_custkey").alias("sha256"), F.when(k % 3 > 0, k % 5).alias("section_position"), F.when(k % 6 == 0, "seen").alias("accepted_reason"))


@query(f'WITH {_FOUND} SELECT "check", severity, count(*) AS findings, count(accepted_reason) AS accepted FROM g GROUP BY ALL')
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.findings(_found(spark, sf_dir))


@query(f"""WITH {_FOUND} SELECT sha256, coalesce(CAST(section_position AS VARCHAR), 'file') AS section_position, array_to_string(list_sort(list(DISTINCT "check")), '|') AS reasons FROM g WHERE severity = 'quarantine' AND accepted_reason IS NULL GROUP BY 1, 2""")
def report_held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is held back, and why."""
    return reports.held_back(_found(spark, sf_dir)).withColumns({"reasons": F.array_join("reasons", "|"), "section_position": F.coalesce(_s(F.col("section_position")), F.lit("file"))})


@query("SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'none', 0")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return reports.table_counts({"orders": o, "customer": read(spark, sf_dir, "customer"), "none": o.filter("false")})


@query("SELECT 'model' AS field, min(n_name) AS built, 'other' AS wanted FROM nation UNION ALL SELECT 'width', NULL, '64'")
def index_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index was built with that search can't use."""
    n = read(spark, sf_dir, "nation").agg(F.min("n_name").alias("value")).select(F.lit("model").alias("field"), "value")
    return reports.index_problems(n.union(spark.createDataFrame([("analyser", "3")], "field string, value string")), {"model": "other", "analyser": "3", "width": "64"})


@query("""WITH r AS (SELECT n_name AS framework_area, c_custkey AS a FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT DISTINCT o_custkey AS a FROM orders WHERE o_custkey % 7 = 0)
SELECT framework_area, count(DISTINCT a) AS agreements FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE a IN (SELECT a FROM s)) = 0""")
def areas_not_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that the register has and none of whose files can be shown."""
    r = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("framework_area"), F.col("c_custkey").alias("agreement_number"))
    return reports.not_loaded(r, read(spark, sf_dir, "orders").filter("o_custkey % 7 = 0").select(F.col("o_custkey").alias("agreement_number")))


# Checks

@query("""WITH f AS (SELECT o_custkey AS sha256, o_orderkey % 9 + 100 AS n, o_orderkey % 4 = 0 AS cited FROM orders), c AS (SELECT c_custkey AS sha256, c_custkey % 9 + 100 AS n FROM customer WHERE c_custkey % 3 > 0)
SELECT DISTINCT 'agreement_number' AS "check", 'quarantine' AS severity, '23.3-' || CAST(f.n AS VARCHAR) || '-2021-001' AS subject, f.sha256 FROM f LEFT JOIN c USING (sha256) WHERE NOT cited AND (c.n IS NULL OR c.n <> f.n)""")
def check_agreement_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements that files state as their own and aren't their card's."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    facts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha256"), F.concat(F.lit("23.3.0"), _s(k % 9 + 100), F.lit("-21:01")).alias("value"), F.when(k % 4 == 0, "citation").otherwise("self").alias("role"))
    cards = read(spark, sf_dir, "customer").filter(c % 3 > 0).select(c.alias("sha256"), F.concat(F.lit("23.3-"), _s(c % 9 + 100), F.lit("-2021-001")).alias("agreement_number"))
    return validation.agreement_number(facts, cards).drop("section_position")


@query("""SELECT DISTINCT 'org_numbers' AS "check", 'quarantine' AS severity, CAST(l_suppkey AS VARCHAR) AS subject, l_orderkey AS sha256 FROM lineitem WHERE (l_orderkey, l_suppkey) NOT IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2)""")
def check_org_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations in files that aren't suppliers of their procurement."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha256"), _s(F.col("l_suppkey")).alias("value"), "l_linenumber")
    return validation.org_numbers(line.drop("l_linenumber"), line.filter("l_linenumber <= 2").select("sha256", F.col("value").alias("org_number"))).drop("section_position")


@query("""WITH p AS (SELECT o_orderkey AS sha256, o_custkey AS a, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_custkey + 1 ELSE o_custkey END AS org, o_orderkey % 4 = 2 AS renamed FROM orders)
SELECT DISTINCT 'supplier_party' AS "check", CASE WHEN org IS NULL OR org <> a THEN 'quarantine' ELSE 'note' END AS severity, coalesce(CAST(org AS VARCHAR), 'Firm ' || CAST(a AS VARCHAR) || ' AB') AS subject, sha256 FROM p JOIN customer ON c_custkey = a WHERE org IS NULL OR org <> a OR renamed""")
def check_supplier_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties that aren't the register's supplier, by number or by name."""
    k, a = F.col("o_orderkey"), F.col("o_custkey")
    org = F.when(k % 4 == 1, a + 1).when(k % 4 > 1, a)
    parties = read(spark, sf_dir, "orders").select(k.alias("sha256"), a.alias("agreement_number"), _s(org).alias("org_number"), F.concat(F.when(k % 4 == 2, "Other ").otherwise("Firm "), _s(a), F.lit(" AB")).alias("name"))
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agreement_number"), _s(F.col("c_custkey")).alias("org_number"), F.concat(F.lit("AB FIRM  "), _s(F.col("c_custkey")), F.lit(" (publ)")).alias("supplier_name"))
    return validation.supplier_party(parties, known).drop("section_position")


@query("""SELECT 'document_type' AS "check", CASE WHEN c_custkey % 5 = 0 THEN 'report' ELSE 'note' END AS severity, CASE WHEN c_custkey % 5 = 0 THEN 'R09' ELSE 'F' || CAST(c_custkey % 3 + 1 AS VARCHAR) END AS subject, CAST(c_custkey AS VARCHAR) AS sha256 FROM customer WHERE c_custkey % 5 < 2""")
def check_document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of unknown types, and those whose type is a guess."""
    k = F.col("c_custkey")
    rule = F.when(k % 5 == 1, F.concat(F.lit("F"), _s(k % 3 + 1))).otherwise("R09")
    return validation.document_type(read(spark, sf_dir, "customer").select(_s(k).alias("sha256"), F.when(k % 5 == 0, "unknown").otherwise("annex").alias("document_type"), rule.alias("type_rule"))).drop("section_position")


@query("""WITH r AS (SELECT c_custkey AS a, DATE '2020-01-01' + CAST(c_custkey % 90 AS INTEGER) AS f, CAST(DATE '2020-01-01' + CAST(c_custkey % 90 AS INTEGER) + INTERVAL 48 MONTH - INTERVAL 1 DAY AS DATE) AS t, CASE WHEN c_custkey % 2 = 0 THEN DATE '2026-01-01' END AS x FROM customer),
s AS (SELECT o_orderkey AS k, o_custkey AS a, CAST(o_orderkey % 5 AS INTEGER) AS sv, CAST(o_orderkey % 7 AS INTEGER) AS ev, CAST(o_orderkey % 11 AS INTEGER) AS m FROM orders),
j AS (SELECT *, CASE sv WHEN 0 THEN NULL WHEN 1 THEN f + 1 WHEN 2 THEN f - 1 ELSE f END AS st, CASE WHEN ev IN (4, 5) THEN 24 END AS ext FROM s JOIN r USING (a)),
e AS (SELECT *, CASE WHEN ev = 0 THEN NULL WHEN ev = 1 THEN CASE WHEN st IS NOT NULL THEN CAST(st + INTERVAL 48 MONTH - INTERVAL 1 DAY AS DATE) END WHEN ev = 2 THEN t WHEN ev IN (3, 4) THEN CAST(f + INTERVAL 24 MONTH - INTERVAL 1 DAY AS DATE) WHEN ev = 5 THEN DATE '2021-01-15' ELSE t + 30 END AS en FROM j),
l AS (SELECT *, CASE WHEN ext IS NOT NULL THEN CAST(en + INTERVAL 1 DAY + to_months(ext) - INTERVAL 1 DAY AS DATE) ELSE coalesce(x, en) END AS lim FROM e WHERE st IS NOT NULL OR en IS NOT NULL),
o AS (SELECT *, CASE WHEN st > f OR (en IS NOT NULL AND en <> t AND NOT (en < t AND t <= lim)) THEN 'deviates' WHEN st < f THEN 'later_start' END AS out FROM l)
SELECT 'agreement_period' AS "check", CASE WHEN out = 'later_start' OR m < 3 THEN 'note' WHEN m < 6 THEN 'report' ELSE 'quarantine' END AS severity, concat_ws(' ', CAST(a AS VARCHAR), out, 'start ' || CAST(st AS VARCHAR), 'end ' || CAST(en AS VARCHAR)) AS subject, k AS sha256 FROM o WHERE out IS NOT NULL""")
def check_agreement_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods stated in files that aren't the register's: dates, lengths from a start, and extensions that reach it or don't."""
    k, a, c = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    start = F.date_add(F.lit("2020-01-01").cast("date"), (c % 90).cast("int"))
    register = read(spark, sf_dir, "customer").select(c.alias("agreement_number"), start.alias("valid_from"), dates.last_day_of_period(start, F.lit(48)).alias("valid_to"), F.when(c % 2 == 0, F.lit("2026-01-01").cast("date")).alias("max_extension_to"))
    x = read(spark, sf_dir, "orders").join(register.select(F.col("agreement_number").alias("o_custkey"), F.col("valid_from").alias("f"), F.col("valid_to").alias("t")), "o_custkey")
    fact = lambda kind, day=None, months=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if day is None else day).cast("date").alias("day"), F.lit(months).cast("int").alias("months"))
    s, e = k % 5, k % 7
    begins = F.when(s == 1, fact("start", F.date_add("f", 1))).when(s == 2, fact("start", F.date_sub("f", 1))).when(s > 2, fact("start", F.col("f")))
    ends = F.when(e == 1, fact("length", months=48)).when(e == 2, fact("end", F.col("t"))).when(e.isin(3, 4), fact("end", dates.last_day_of_period(F.col("f"), F.lit(24)))).when(e == 5, fact("end", F.lit("2021-01-15"))).when(e == 6, fact("end", F.date_add("t", 30)))
    extension = F.when(e.isin(4, 5), fact("extension", months=24))
    facts = x.select(k.alias("sha256"), F.explode(F.array_compact(F.array(begins, ends, extension))).alias("x")).select("sha256", F.lit(1).alias("statement"), "x.*", F.lit(None).cast("string").alias("scope"))
    cards = x.select(k.alias("sha256"), a.alias("agreement_number"))
    none = lambda schema: spark.createDataFrame([], schema)
    compared = validation.compared_periods(validation.stated_periods(facts), cards, register, none("sha256 long, page long, page_title string"), none("page long, valid_from date, valid_to date, max_extension_to date"))
    stage = x.select(k.alias("sha256"), F.when(k % 11 < 3, "procurement").otherwise("agreement").alias("stage"), F.when(k % 11 < 6, "page").otherwise("document").alias("source"))
    return validation.agreement_period(compared.join(stage, "sha256")).drop("section_position")


_CITED = """c AS (SELECT DISTINCT o_custkey AS draft, o_orderkey % 40 AS f, o_orderkey % 7 AS p FROM orders), a AS (SELECT c_custkey % 40 AS tf, CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 7 END AS tp, (c_custkey + 3) % 40 AS f, c_custkey % 5 AS p FROM customer WHERE c_custkey % 13 = 0)"""


@query(f"""WITH {_CITED}, due AS (SELECT c.draft, c.f AS of_f, c.p AS of_p, a.f, a.p FROM c JOIN a ON c.f = a.tf AND (a.tp IS NULL OR a.tp = c.p)), done AS (SELECT DISTINCT due.draft, of_f, of_p FROM due JOIN c ON c.draft = due.draft AND c.f = due.f AND c.p = due.p)
SELECT DISTINCT draft, of_f AS sha256, of_p AS section_position FROM due WHERE (draft, of_f, of_p) NOT IN (SELECT draft, of_f, of_p FROM done)""")
def check_latest_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited sections that were amended, where no amendment is cited."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    cited = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft"), (k % 40).alias("sha256"), (k % 7).alias("section_position")).distinct()
    amendments = read(spark, sf_dir, "customer").filter(c % 13 == 0).select((c % 40).alias("target_sha256"), F.when(c % 6 > 0, c % 7).alias("target_section_position"), ((c + 3) % 40).alias("sha256"), (c % 5).alias("section_position"))
    return validation.latest_wording(cited, amendments)


_STATED = """s AS (SELECT o_orderkey AS draft, t.statement, CASE t.statement WHEN 1 THEN 'agreement' WHEN 2 THEN 'organisation' ELSE 'date' END AS kind, CASE t.statement WHEN 1 THEN 'A' || CAST(o_custkey % 70 AS VARCHAR) WHEN 2 THEN 'O' || CAST((o_custkey + o_orderkey % 2) % 70 AS VARCHAR) ELSE CAST(DATE '2020-01-01' + CAST((o_custkey + o_orderkey % 3) % 70 AS INTEGER) AS VARCHAR) END AS value, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE t.statement END AS place FROM orders, (VALUES (1), (2), (3)) t(statement) WHERE t.statement > 1 OR o_orderkey % 5 > 0),
r AS (SELECT 'A' || CAST(i AS VARCHAR) AS a, 'O' || CAST(i AS VARCHAR) AS o, CAST(DATE '2020-01-01' + CAST(i AS INTEGER) AS VARCHAR) AS d FROM range(0, 60) t(i)), v AS (SELECT a, 'organisation' AS kind, o AS value FROM r UNION ALL SELECT a, 'date', d FROM r)"""


@query(f"""WITH {_STATED}, own AS (SELECT DISTINCT draft, place, value AS a FROM s WHERE kind = 'agreement'), f AS (SELECT DISTINCT draft, place, kind, value FROM s WHERE kind <> 'agreement'),
j AS (SELECT f.*, EXISTS (SELECT 1 FROM own WHERE own.draft = f.draft AND own.place = f.place) AS near, EXISTS (SELECT 1 FROM own WHERE own.draft = f.draft) AS far FROM f)
SELECT draft, place AS statement, 'agreement ' || a AS problem FROM own WHERE a NOT IN (SELECT a FROM r)
UNION ALL SELECT draft, place, kind || ' ' || value FROM j WHERE near AND NOT EXISTS (SELECT 1 FROM own JOIN v ON v.a = own.a WHERE own.draft = j.draft AND own.place = j.place AND v.kind = j.kind AND v.value = j.value)
UNION ALL SELECT draft, place, kind || ' ' || value FROM j WHERE NOT near AND far AND NOT EXISTS (SELECT 1 FROM own JOIN v ON v.a = own.a WHERE own.draft = j.draft AND v.kind = j.kind AND v.value = j.value)
UNION ALL SELECT draft, place, kind || ' ' || value FROM j WHERE NOT far AND NOT EXISTS (SELECT 1 FROM v WHERE v.kind = j.kind AND v.value = j.value)""")
def check_register_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements, organisations and dates in drafts that the register doesn't back."""
    k, a = F.col("o_orderkey"), F.col("o_custkey")
    day = lambda n: _s(F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")))
    at = F.col("statement")
    value = F.when(at == 1, F.concat(F.lit("A"), _s(a % 70))).when(at == 2, F.concat(F.lit("O"), _s((a + k % 2) % 70))).otherwise(day((a + k % 3) % 70))
    stated = read(spark, sf_dir, "orders").withColumn("statement", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))).filter((at > 1) | (k % 5 > 0))
    stated = stated.select(k.alias("draft"), F.when(k % 4 == 0, 1).otherwise(at).alias("statement"), F.when(at == 1, "agreement").when(at == 2, "organisation").otherwise("date").alias("kind"), value.alias("value"))
    i = F.col("id")
    known = spark.range(60).select(F.concat(F.lit("A"), _s(i)).alias("agreement_key"), F.concat(F.lit("O"), _s(i)).alias("org_number"), F.date_add(F.lit("2020-01-01").cast("date"), i.cast("int")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(None).cast("date").alias("max_extension_to"))
    return validation.register_facts(stated, known)


@query("""WITH r AS (SELECT c_custkey AS a, DATE '2020-01-01' + CAST(c_custkey % 30 AS INTEGER) AS f, DATE '2024-06-01' AS t FROM customer), s AS (SELECT o_orderkey AS draft, o_custkey AS a, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2020-01-01' + CAST((o_custkey + o_orderkey % 5) % 30 AS INTEGER) ELSE DATE '2024-05-30' + CAST(o_orderkey % 5 AS INTEGER) END AS day FROM orders)
SELECT draft, a AS agreement_number, day FROM s JOIN r USING (a) WHERE (abs(date_diff('day', f, day)) = 1 OR abs(date_diff('day', t, day)) = 1) AND day <> f AND day <> t""", dates=("day",))
def dates_nearly_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in drafts that are a day off the register's."""
    k, a, c = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    at = lambda d, n: F.date_add(F.lit(d).cast("date"), n.cast("int"))
    stated = read(spark, sf_dir, "orders").select(k.alias("draft"), a.alias("agreement_number"), F.when(k % 2 == 0, at("2020-01-01", (a + k % 5) % 30)).otherwise(at("2024-05-30", k % 5)).alias("day"))
    known = read(spark, sf_dir, "customer").select(c.alias("agreement_number"), at("2020-01-01", c % 30).alias("valid_from"), F.lit("2024-06-01").cast("date").alias("valid_to"), F.lit(None).cast("date").alias("max_extension_to"))
    return validation.near_misses(stated, known)


@query("""SELECT c_custkey AS draft, CASE WHEN c_custkey % 2 = 0 THEN 'citations' ELSE 'register' END AS "check", CASE WHEN c_custkey % 2 = 0 THEN 'too_short' ELSE 'date ' || CAST(c_custkey AS VARCHAR) END AS problem FROM customer WHERE c_custkey % 5 < 2""")
def answer_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems of drafts in one table."""
    k = F.col("c_custkey")
    d = read(spark, sf_dir, "customer").filter(k % 5 < 2).select(k.alias("draft"))
    parts = {"citations": d.filter("draft % 2 = 0").withColumn("problem", F.lit("too_short")), "register": d.filter("draft % 2 = 1").withColumn("problem", F.concat(F.lit("date "), _s(F.col("draft"))))}
    return reports.answer_problems(parts)[0]


# Lookups and runs

@query("SELECT CAST(o_orderkey AS BIGINT) AS section_position, o_orderstatus AS title, 1 AS n FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderkey % 3 > 0")
def outline_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of a file, without what is held back."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha256"), F.col("o_orderkey").cast("long").alias("section_position"), F.col("o_orderstatus").alias("title"))
    first = o.agg(F.min("sha256")).first()[0]
    shown, _ = tools.outline(o, o.filter("section_position % 3 > 0"), first)
    return shown.select("section_position", "title", F.lit(1).alias("n"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS section_position, o_orderstatus AS title FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def section_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section by its position."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha256"), F.col("o_orderkey").cast("long").alias("section_position"), F.col("o_orderstatus").alias("title"), _s(F.col("o_orderkey")).alias("number"))
    first = o.orderBy("section_position").first()
    return tools.read_section(o, o, first["sha256"], position=first["section_position"]).select("section_position", "title")


@query("""WITH l AS (SELECT c_custkey AS draft, unnest(['- quote ' || CAST(c_custkey AS VARCHAR), '- a date and a quote', 'no rule', CASE WHEN c_custkey % 3 = 0 THEN '- a date' ELSE '- odd' END]) AS line FROM customer)
SELECT CASE WHEN contains(line, 'quote') THEN 'citation' WHEN contains(line, 'date') THEN 'fact' ELSE 'other' END AS rule, count(DISTINCT draft) AS drafts FROM l WHERE starts_with(line, '- ') GROUP BY 1""")
def rejections_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many drafts' feedback each rule rejects something."""
    k = F.col("c_custkey")
    said = F.concat(F.lit("- quote "), _s(k), F.lit("\n- a date and a quote\nno rule\n"), F.when(k % 3 == 0, "- a date").otherwise("- odd"))
    return runs.problems(read(spark, sf_dir, "customer").select(k.alias("draft"), said.alias("text")), [("citation", "quote"), ("fact", "date")])


@query("SELECT o_orderkey AS call, 'done' AS text FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, 'stopped' FROM orders WHERE o_orderkey % 4 = 0")
def open_calls_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without a result get one."""
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"))
    return runs.answer_open_calls(calls, calls.filter("call % 4 > 0").withColumn("text", F.lit("done")), "stopped")


# Facts in texts

def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks made from orders, whose dates and lengths differ; a block in nine is a cover whose period runs over two blocks."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (k % 400).cast("int")), "yyyy-MM-dd")
    word = F.element_at(F.array(*[F.lit(w) for w in ("tre", "tolv", "fyrtioåtta")]), (k % 3 + 1).cast("int"))
    said = (
        F.when(k % 9 == 0, F.concat(F.lit("Avtal om varor\nGiltig "), day, F.lit(" – "), later))
        .when(k % 9 == 1, F.concat(F.lit("Delområde Nord: Ramavtalet träder i kraft den "), day, F.lit(". Lagen gäller från 2009-01-01.")))
        .when(k % 9 == 2, F.concat(F.lit("Avtalet gäller från och med "), day, F.lit(" till och med "), later, F.lit(".")))
        .when(k % 9 == 3, F.concat(F.lit("Avtalsperioden är "), word, F.lit(" månader. Avtalet kan förlängas med högst "), (k % 4 + 1).cast("string"), F.lit(" år eller "), (k % 30 + 1).cast("string"), F.lit(" månader. Sedan 24 månader.")))
        .when(k % 9 == 4, F.concat(F.lit("Planerad avtalsstart: "), day, F.lit(". Avtalet upphör att gälla 2021-02-30.")))
        .when(k % 9 == 5, F.concat(F.lit("Signerat "), day, F.lit(" 10:15:00 av N.N.")))
        .when(k % 9 == 6, "Avtalets första dag: ÅÅÅÅ-MM-DD")
        .when(k % 9 == 7, F.concat(F.lit("Avtalstid: "), day, F.lit(" - "), later, F.lit("; möten "), day, F.lit(" - "), later))
        .otherwise(F.concat(F.lit("Avtalet löper längst till den "), (k % 28 + 1).cast("string"), F.lit(" mars 2027.")))
    )
    return read(spark, sf_dir, "orders").select(k.alias("doc"), F.lit(1).alias("position"), said.alias("text"), (k % 9 == 0).alias("is_cover"), (k % 5).alias("page"), F.lit(2).alias("certificate_page"))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS VARCHAR) AS e FROM orders),
f AS (SELECT k, 'P1' AS rule, 'start' AS kind, d AS value FROM o WHERE k % 9 = 0 UNION ALL SELECT k, 'P1', 'end', e FROM o WHERE k % 9 = 0
UNION ALL SELECT k, 'P2', 'start', d FROM o WHERE k % 9 IN (1, 2) UNION ALL SELECT k, 'P5', 'start', d FROM o WHERE k % 9 = 2 UNION ALL SELECT k, 'P5', 'end', e FROM o WHERE k % 9 = 2
UNION ALL SELECT k, 'P7', 'months', CASE k % 3 WHEN 0 THEN '3' WHEN 1 THEN '12' ELSE '48' END FROM o WHERE k % 9 = 3 UNION ALL SELECT k, 'P8', 'extension_months', CAST(greatest((k % 4 + 1) * 12, k % 30 + 1) AS VARCHAR) FROM o WHERE k % 9 = 3
UNION ALL SELECT k, 'P9', 'planned_start', d FROM o WHERE k % 9 = 4 UNION ALL SELECT k, 'P11', 'signed_on', d FROM o WHERE k % 9 = 5 AND k % 5 >= 2 UNION ALL SELECT k, 'P10', 'placeholder', 'date' FROM o WHERE k % 9 = 6
UNION ALL SELECT k, 'P6', 'start', d FROM o WHERE k % 9 = 7 UNION ALL SELECT k, 'P6', 'end', e FROM o WHERE k % 9 = 7 UNION ALL SELECT k, 'P3', 'end', '2027-03-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') FROM o WHERE k % 9 = 8)
SELECT k AS doc, rule, kind, value, CASE WHEN k % 9 = 1 THEN 'Nord' ELSE '' END AS scope, CAST(1 AS INTEGER) AS statement FROM f""")
def period_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, lengths and extensions in texts, with the rule that found each."""
    return periods.facts(_blocks(spark, sf_dir)).select("doc", "rule", "kind", "value", F.coalesce("scope", F.lit("")).alias("scope"), "statement")


@query("""SELECT o_orderkey AS doc, CAST(n AS INTEGER) AS place, CASE n WHEN 1 THEN 'Se t.ex. avsnitt ' || CAST(o_orderkey AS VARCHAR) || ' kap. 2.' WHEN 2 THEN 'Nr. 3 gäller!' ELSE 'A. Berg skrev.' END AS sentence FROM orders, range(1, 4) t(n)""")
def sentences_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of texts with abbreviations in them."""
    said = F.concat(F.lit("Se t.ex. avsnitt "), _s(F.col("o_orderkey")), F.lit(" kap. 2. Nr. 3 gäller!  A. Berg skrev."))
    found = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.posexplode(periods.sentences(said)).alias("place", "sentence"))
    return found.withColumn("place", F.col("place") + 1)


# Text forms and pages

@query("""SELECT s_suppkey AS k, 'Area › ' || s_name || ' › Part' AS header, 'Area' || chr(10) || chr(10) || s_name AS embedded, sha256(s_name) AS hash, lower(s_name) AS title, 'firm ' || CAST(s_suppkey AS VARCHAR) AS company,
CAST(s_suppkey % 7 + 20 AS INTEGER) AS part, s_suppkey % 3 = 0 AS ocr FROM supplier""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, hashes, titles, company names and numbers in the forms in which they are compared."""
    k, n = F.col("s_suppkey"), F.col("s_name")
    number = F.concat(F.lit("6."), _s(k % 7 + 20), F.lit(".4."))
    return read(spark, sf_dir, "supplier").select(
        k.alias("k"), text.context_header(F.lit("Area"), n, F.lit("Part")).alias("header"), text.embedded_text(F.lit("Area"), n).alias("embedded"), text.text_hash(n).alias("hash"), text.title_form(F.concat(n, F.lit(" .: "))).alias("title"),
        text.company_form(F.concat(F.lit("AB Firm, "), _s(k), F.lit(" (publ)"))).alias("company"), text.dotted(number)[1].alias("part"), pages.needs_ocr(F.when(k % 3 == 0, 10).otherwise(400), F.lit(0.7)).alias("ocr"),
    )


@query("""WITH l AS (SELECT page_id, url, page_id % 10 AS site, CASE WHEN page_id % 3 = 0 THEN 'group ' || CAST(page_id % 7 AS VARCHAR) END AS label FROM pages)
SELECT page_id, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY site ORDER BY page_id ROWS UNBOUNDED PRECEDING), 'none') AS label FROM l""")
def labels_carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a label has the last one before it."""
    i = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select("page_id", (i % 10).alias("site"), F.when(i % 3 == 0, F.concat(F.lit("group "), _s(i % 7))).alias("label"))
    return pages.carried_forward(rows, "site", "page_id", "label").select("page_id", F.coalesce("label", F.lit("none")).alias("label"))


@query("SELECT page_id FROM pages WHERE page_id % 5 IN (2, 3) OR (page_id + 1) % 5 IN (2, 3)")
def pages_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of any of the procurements asked for."""
    i = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select("page_id", F.array(F.concat(F.lit("P-"), _s(i % 5)), F.concat(F.lit("P-"), _s((i + 1) % 5))).alias("procurement_numbers"))
    return pages.select_pages(rows, ["P-2", "P-3"]).select("page_id")


@query("""WITH b AS (SELECT o_custkey AS doc, o_orderkey AS page, 'header ' || CAST(o_orderkey % 3 AS VARCHAR) AS line FROM orders WHERE o_orderkey % 2 = 0)
SELECT doc, line FROM b GROUP BY ALL HAVING count(DISTINCT page) > 1""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page headers that more than one page has."""
    k = F.col("o_orderkey")
    blocks = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("position"), F.when(k % 2 == 0, "page_header").otherwise("text").alias("kind"), k.alias("page"), F.concat(F.lit(" Header  "), _s(k % 3)).alias("text"))
    return chunking.running_headers(blocks)


@query("""WITH l AS (SELECT o_custkey AS doc, o_orderkey AS position, o_orderkey % 4 AS m FROM orders), n AS (SELECT *, sum(CASE WHEN m < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l)
SELECT doc, position, m = 0 OR (m = 1 AND near >= 3) AS in_contents FROM n""")
def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table of contents: a dotted leader, or a number and a page among such lines."""
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, F.concat(F.lit("Villkor ....... "), _s(k % 90))).when(k % 4 == 1, F.concat(F.lit("2.1 Vite och pris "), _s(k % 90))).otherwise("Avtalet gäller.")
    lines = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("position"), said.alias("text"))
    return chunking.contents_lines(lines).select("doc", "position", "in_contents")
