"""Queries of the register: agreements made from orders, suppliers from supplier, sub-areas from nation, region and line number."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import identifiers
from spandrel.operators import merge, register
from spandrel.plans.common import query, read, spread

_RAW = """
raw AS (SELECT CAST((((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 2600 + date_diff('day', DATE '1995-01-01', l_shipdate) AS BIGINT) AS source_row,
  '23.3-' || CAST(10 + o_orderkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0') AS agreement,
  CASE WHEN l_suppkey % 7 = 0 THEN s_name || '  (f.d. Old ' || s_name || ')' ELSE s_name END AS supplier,
  CASE WHEN l_suppkey % 11 = 0 THEN 'fi' || CAST(10000000 + l_suppkey AS VARCHAR) WHEN l_suppkey % 13 = 0 THEN 'abc' ELSE CAST(5560000000 + l_suppkey AS VARCHAR) || '  ' END AS org,
  r_name AS area, n_name || ' / Zone ' || CAST(l_linenumber % 3 AS VARCHAR) AS sub_area,
  strftime(o_orderdate, '%Y-%m-%d') AS valid_from, strftime(l_shipdate, '%Y-%m-%d') AS valid_to,
  CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate + INTERVAL 365 DAY, '%Y-%m-%d') WHEN l_linenumber = 7 THEN 'soon' ELSE '' END AS max_extension_to
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_ROWS = f"""{_RAW},
read AS (SELECT source_row, agreement AS agreement_number, regexp_extract(agreement, '^(.*)-[0-9]+$', 1) AS procurement_number, regexp_extract(agreement, '-([0-9]+)$', 1) AS sequence,
  trim(regexp_replace(supplier, '\\s*\\(f\\.d\\..*$', '')) AS supplier_name, nullif(regexp_extract(supplier, '\\(f\\.d\\.\\s*([^)]+)\\)$', 1), '') AS former_supplier_name,
  CASE WHEN regexp_matches(trim(org), '^[0-9]{{10}}$') THEN trim(org)[1:6] || '-' || trim(org)[7:10] WHEN regexp_matches(upper(org), '^[A-Z]{{2,3}}:?[0-9]{{5,12}}$') THEN upper(org) END AS org_number,
  area AS framework_area, string_split(sub_area, ' / ') AS sub_area_path, CAST(valid_from AS DATE) AS valid_from, CAST(valid_to AS DATE) AS valid_to,
  TRY_CAST(nullif(max_extension_to, '') AS DATE) AS max_extension_to, max_extension_to = 'soon' AS odd FROM raw),
rows_ AS (SELECT * EXCLUDE (odd) FROM read WHERE org_number IS NOT NULL AND NOT odd)"""
_TABLES = f"""{_ROWS},
supplier_names AS (SELECT org_number, supplier_name AS name, arg_min(former_supplier_name, source_row) FILTER (WHERE former_supplier_name IS NOT NULL) AS former_name FROM rows_ GROUP BY ALL),
agreements AS (SELECT agreement_number, arg_min(procurement_number, source_row) AS procurement_number, arg_min(sequence, source_row) AS sequence, arg_min(org_number, source_row) AS org_number, arg_min(supplier_name, source_row) AS supplier_name FROM rows_ GROUP BY 1),
ranked AS (SELECT *, array_to_string(sub_area_path, ' / ') AS path, row_number() OVER (PARTITION BY agreement_number, framework_area, array_to_string(sub_area_path, ' / ') ORDER BY source_row) AS place FROM rows_),
links AS (SELECT agreement_number, framework_area, path, valid_from, valid_to, max_extension_to FROM ranked WHERE place = 1)"""
_SEARCH = "SELECT agreement_number, procurement_number, supplier_name, org_number, framework_area, path AS sub_area, valid_from, valid_to, max_extension_to FROM agreements JOIN links USING (agreement_number)"


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows; source_row is a decimal, as the numbers made from the keys of large tables need more than 64 bits."""
    t = lambda n: read(spark, sf_dir, n)
    lines = spread(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    joined = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = lambda c: F.col(c).cast("string")
    day = lambda c: F.col(c).cast("date").cast("string")
    keys = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")
    return joined.select(
        (keys.cast("decimal(20,0)") * 2600 + F.datediff("l_shipdate", F.lit("1995-01-01"))).alias("source_row"),
        F.concat(F.lit("23.3-"), (F.col("o_orderkey") + 10).cast("string"), F.lit("-"), F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0")).alias("agreement"),
        F.when(F.col("l_suppkey") % 7 == 0, F.concat("s_name", F.lit("  (f.d. Old "), "s_name", F.lit(")"))).otherwise(F.col("s_name")).alias("supplier"),
        F.when(F.col("l_suppkey") % 11 == 0, F.concat(F.lit("fi"), (F.col("l_suppkey") + 10000000).cast("string"))).when(F.col("l_suppkey") % 13 == 0, "abc").otherwise(F.concat((F.col("l_suppkey") + 5560000000).cast("string"), F.lit("  "))).alias("org"),
        F.col("r_name").alias("area"),
        F.concat("n_name", F.lit(" / Zone "), (F.col("l_linenumber") % 3).cast("string")).alias("sub_area"),
        day("o_orderdate").alias("valid_from"),
        day("l_shipdate").alias("valid_to"),
        F.when(F.col("l_linenumber") % 2 == 0, F.date_add(F.col("l_shipdate").cast("date"), 365).cast("string")).when(F.col("l_linenumber") == 7, "soon").otherwise("").alias("max_extension_to"),
    )


def _numbers(*columns: str) -> dict[str, Column]:
    """Row numbers as 64-bit integers, for results. Beyond these SQL has no value, and the lower 64 bits are returned; rows are compared by whole numbers before."""
    half, whole = F.lit(Decimal(2**63)), F.lit(Decimal(2**64))
    return {c: (F.pmod(F.col(c) + half, whole) - half).cast("long") for c in columns}


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.normalize(raw_rows(spark, sf_dir))[0]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return register.tables(rows(spark, sf_dir))


@query(f"WITH {_ROWS} SELECT * REPLACE (array_to_string(sub_area_path, '|') AS sub_area_path) FROM rows_", dates=("valid_from", "valid_to", "max_extension_to"))
def register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows that could be read."""
    return rows(spark, sf_dir).withColumns({**_numbers("source_row"), "sub_area_path": F.array_join("sub_area_path", "|")})


@query(f"WITH {_ROWS} SELECT source_row, CASE WHEN org_number IS NULL THEN 'org has an unknown format' ELSE 'max_extension_to has an unknown format' END AS reason FROM read WHERE org_number IS NULL OR odd")
def register_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows that couldn't, and why."""
    return register.normalize(raw_rows(spark, sf_dir))[1].withColumns(_numbers("source_row"))


@query(f"WITH {_TABLES} SELECT * FROM agreements")
def register_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["agreement"]


@query(f"WITH {_TABLES} SELECT * FROM supplier_names")
def register_supplier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["supplier_name"]


@query(f"""WITH {_ROWS}, p AS (SELECT DISTINCT framework_area, sub_area_path[1:i] AS p FROM rows_, unnest(range(1, len(sub_area_path) + 1)) AS t(i))
SELECT framework_area, array_to_string(p, ' / ') AS path, p[-1] AS name, CAST(len(p) AS INTEGER) AS level, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], ' / ') END AS parent_path FROM p""")
def register_sub_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level of every path, with its parent."""
    return tables(spark, sf_dir)["sub_area"]


@query(f"WITH {_TABLES} SELECT * FROM links", dates=("valid_from", "valid_to", "max_extension_to"))
def register_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["agreement_sub_area"]


@query(f"""WITH {_ROWS}, k AS (SELECT *, array_to_string(sub_area_path, ' / ') AS path FROM rows_),
f AS (SELECT agreement_number, min(source_row) AS first_row, arg_min(org_number, source_row) AS org FROM k GROUP BY 1),
o AS (SELECT agreement_number, org_number, framework_area, path, min(source_row) AS first_row FROM k GROUP BY ALL)
SELECT source_row, 'org_number' AS kind, first_row FROM k JOIN f USING (agreement_number) WHERE org_number <> org
UNION ALL SELECT source_row, 'repeated', first_row FROM k JOIN o USING (agreement_number, org_number, framework_area, path) WHERE source_row > first_row""")
def register_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that contradict or repeat an earlier one."""
    return register.conflicts(rows(spark, sf_dir)).withColumns(_numbers("source_row", "first_row"))


@query(f"WITH {_ROWS} SELECT org_number, min(source_row) AS source_row, arg_min(supplier_name, source_row) AS supplier_name FROM rows_ WHERE NOT regexp_matches(org_number, '^[0-9]{{6}}-[0-9]{{4}}$') GROUP BY 1")
def register_foreign_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.foreign_org_numbers(rows(spark, sf_dir)).withColumns(_numbers("source_row"))


@query(f"WITH {_TABLES}, a AS ({_SEARCH}) SELECT * FROM a WHERE sub_area ILIKE '%zone 1%' AND lower(framework_area) = 'asia' AND DATE '1996-06-01' BETWEEN valid_from AND valid_to", dates=("valid_from", "valid_to", "max_extension_to"))
def register_search_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements valid on a day in the sub-areas of an area that have every part of a path."""
    return register.search(tables(spark, sf_dir), area=" asia ", sub_area="zone 1", valid_on="1996-06-01")


@query(f"""WITH {_TABLES}, known AS (SELECT DISTINCT org_number FROM supplier_names WHERE lower(name) LIKE '%#00000004%' OR lower(former_name) LIKE '%#00000004%'),
a AS ({_SEARCH}) SELECT * FROM a WHERE lower(supplier_name) LIKE '%#00000004%' OR org_number IN (SELECT org_number FROM known)""", dates=("valid_from", "valid_to", "max_extension_to"))
def register_search_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreements of suppliers found by a part of any of their names."""
    return register.search(tables(spark, sf_dir), supplier=" #00000004 ")


@query(f"""WITH {_TABLES}, a AS ({_SEARCH}), f AS (SELECT * FROM a WHERE framework_area = 'EUROPE')
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY framework_area, agreement_number, sub_area LIMIT 20 OFFSET 40""", dates=("valid_from", "valid_to", "max_extension_to"))
def register_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a search, with the total."""
    return register.search_page(register.search(tables(spark, sf_dir), area="Europe"), 20, 40)


@query(f"WITH {_TABLES} SELECT org_number, array_to_string(list_sort(list_distinct(list(former_name))), '|') AS former_names FROM supplier_names WHERE former_name IS NOT NULL AND org_number IN (SELECT org_number FROM agreements) GROUP BY 1")
def register_former_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return register.former_names(t, t["agreement"]).withColumn("former_names", F.array_join("former_names", "|"))


@query(f"WITH {_TABLES} SELECT agreement_number, min(valid_from) AS valid_from, max(valid_to) AS valid_to, max(max_extension_to) AS max_extension_to FROM links GROUP BY 1", dates=("valid_from", "valid_to", "max_extension_to"))
def register_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.period(tables(spark, sf_dir)["agreement_sub_area"])


@query("""WITH k AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '23.3.' || CAST(1000 + c_custkey AS VARCHAR) || '-' || lpad(CAST(c_custkey % 27 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0')
 WHEN 1 THEN '23.3-0' || CAST(1000 + c_custkey AS VARCHAR) || '-2021' WHEN 2 THEN CAST(1000 + c_custkey AS VARCHAR) || '/05' WHEN 3 THEN '96-' || CAST(c_custkey AS VARCHAR) || '-2015' WHEN 4 THEN '23.3.12.20' ELSE 'no number' END AS raw FROM customer)
SELECT id, raw, CASE id % 6 WHEN 0 THEN '23.3-' || CAST(1000 + id AS VARCHAR) || '-' || CAST(2000 + id % 27 AS VARCHAR) || '-' || lpad(CAST(id % 90 + 10 AS VARCHAR), 3, '0')
 WHEN 1 THEN '23.3-' || CAST(1000 + id AS VARCHAR) || '-2021' WHEN 2 THEN raw WHEN 3 THEN '96-' || CAST(id AS VARCHAR) || '-2015' END AS key FROM k""")
def agreement_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for every way in which a number is written."""
    i = F.col("c_custkey")
    s = lambda c: c.cast("string")
    raw = (
        F.when(i % 6 == 0, F.concat(F.lit("23.3."), s(i + 1000), F.lit("-"), F.lpad(s(i % 27), 2, "0"), F.lit(":"), F.lpad(s(i % 90 + 10), 2, "0")))
        .when(i % 6 == 1, F.concat(F.lit("23.3-0"), s(i + 1000), F.lit("-2021")))
        .when(i % 6 == 2, F.concat(s(i + 1000), F.lit("/05")))
        .when(i % 6 == 3, F.concat(F.lit("96-"), s(i), F.lit("-2015")))
        .when(i % 6 == 4, "23.3.12.20")
        .otherwise("no number")
    )
    return read(spark, sf_dir, "customer").select(i.alias("id"), raw.alias("raw")).withColumn("key", identifiers.agreement_key(F.col("raw")))


@query("""WITH n AS (SELECT c_custkey AS id, lpad(CAST((c_custkey * 7919 + 5560000000) % 10000000000 AS VARCHAR), 10, '0') AS d FROM customer)
SELECT id, d[1:6] || '-' || d[7:10] AS org, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(d[i] AS INT) * 2) // 10 + (CAST(d[i] AS INT) * 2) % 10 ELSE CAST(d[i] AS INT) END)) % 10 = 0 AS valid FROM n""")
def org_number_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation numbers and whether their check digit is right."""
    digits = F.lpad(((F.col("c_custkey") * 7919 + 5560000000) % 10000000000).cast("string"), 10, "0")
    n = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), identifiers.normalize_org_number(digits).alias("org"))
    return n.withColumn("valid", identifiers.luhn_valid(F.col("org")))


# Merges

_STORED = "s AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, round(c_acctbal * 2, 2) AS v, c_mktsegment AS seg FROM customer WHERE c_custkey % 2 = 0)"


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.filter(key % 3 != 0).select(key.alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("seg")), c.filter(key % 2 == 0).select(key.alias("k"), F.round(F.col("c_acctbal") * 2, 2).alias("v"), F.col("c_mktsegment").alias("seg"))


@query(f"WITH {_STORED} SELECT coalesce(n.k, s.k) AS k, CASE WHEN n.k IS NULL THEN s.v ELSE n.v END AS v, coalesce(n.seg, s.seg) AS seg FROM s FULL JOIN n ON s.k = n.k")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(*_stored(spark, sf_dir), ["k"])


@query(f"WITH {_STORED} SELECT * FROM s UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM s)")
def merge_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.insert_missing(*_stored(spark, sf_dir), ["k"])


@query(f"WITH {_STORED} SELECT * FROM s WHERE seg <> 'BUILDING' UNION ALL SELECT * FROM n WHERE seg = 'BUILDING'")
def merge_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _stored(spark, sf_dir)
    scope = spark.createDataFrame([("BUILDING",)], "seg string")
    return merge.replace(s, n.join(scope, "seg", "left_semi").select(n.columns), scope, ["seg"])


@query(f"WITH {_STORED} SELECT s.k, s.v, s.seg, CASE WHEN s.k IN (SELECT k FROM n) THEN NULL WHEN s.k % 5 = 0 THEN DATE '2026-01-01' ELSE DATE '2026-10-07' END AS missing_since FROM s", dates=("missing_since",))
def merge_mark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _stored(spark, sf_dir)
    dated = s.withColumn("missing_since", F.when(F.col("k") % 5 == 0, F.lit("2026-01-01").cast("date")))
    return merge.mark_missing(dated, n, ["k"], F.lit("2026-10-07").cast("date"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def merge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return merge.cascade(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), parent, ["l_orderkey"])


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, ts, event_id) AS p FROM events)
SELECT user_id, event_id, event_type FROM r WHERE p = 1""")
def merge_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key, in an order of kinds, then time."""
    order = [F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.col("ts"), F.col("event_id")]
    return merge.first_per_key(read(spark, sf_dir, "events"), ["user_id"], order).select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT n_name AS name, 'nation' AS kind FROM nation UNION SELECT r_name, 'region' FROM region UNION SELECT n_name, 'nation' FROM nation WHERE n_regionkey = 1")
def merge_union_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    named = lambda d, c, k: d.select(F.col(c).alias("name"), F.lit(k).alias("kind"))
    return merge.union_unique([named(n, "n_name", "nation"), named(read(spark, sf_dir, "region"), "r_name", "region"), named(n.filter("n_regionkey = 1"), "n_name", "nation")])


@query("""WITH f AS (SELECT url, CASE WHEN page_id % 5 = 0 THEN 'zip' ELSE 'pdf' END AS file_type, CASE WHEN page_id % 3 = 0 THEN 'v' || CAST(page_id % 4 AS VARCHAR) END AS version, page_id % 17 = 0 AS failed, sha256(html) AS sha256, page_id FROM pages),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY url, file_type, version NULLS FIRST, failed, sha256) AS p FROM f) WHERE p = 1),
o AS (SELECT DISTINCT url, CASE WHEN page_id % 3 = 0 THEN 'v1' END AS version, CASE WHEN page_id % 4 = 0 THEN sha256(html) ELSE sha256(url) END AS sha256 FROM pages WHERE page_id % 2 = 0 AND url IN (SELECT url FROM pages GROUP BY url HAVING count(*) = 1)),
j AS (SELECT u.url, file_type, u.version, CASE WHEN file_type <> 'pdf' THEN 'EXCLUDED' WHEN u.version IS NOT NULL AND u.version = o.version THEN 'SAME_VERSION' WHEN failed THEN 'FAILED' WHEN o.sha256 IS NULL THEN 'NEW' WHEN o.sha256 = u.sha256 THEN 'UNCHANGED' ELSE 'UPDATED' END AS status,
  u.sha256 AS new, o.sha256 AS old FROM u LEFT JOIN o ON u.url = o.url)
SELECT url, file_type, version, status, CASE WHEN status IN ('NEW', 'UPDATED', 'UNCHANGED') THEN new ELSE old END AS sha256 FROM j""")
def fetch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fetched files are new, updated or unchanged against what is stored."""
    p, i = read(spark, sf_dir, "pages"), F.col("page_id")
    fetched = p.select("url", F.when(i % 5 == 0, "zip").otherwise("pdf").alias("file_type"), F.when(i % 3 == 0, F.concat(F.lit("v"), (i % 4).cast("string"))).alias("version"), (i % 17 == 0).alias("failed"), F.sha2("html", 256).alias("sha256"))
    once = p.groupBy("url").count().filter("count = 1").select("url")
    stored = p.filter(i % 2 == 0).join(once, "url", "left_semi").select("url", F.when(i % 3 == 0, "v1").alias("version"), F.when(i % 4 == 0, F.sha2("html", 256)).otherwise(F.sha2("url", 256)).alias("sha256"))
    return merge.changes(stored, fetched, ["pdf", "docx"])
