"""Keys of large tables: numbers made from them need more room than those of the small ones."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from spandrel.functions import dates
from spandrel.operators import references, register
from spandrel.plans import common, prose_queries, registry
from tests import oracle
from tests.conftest import SMALL, rows

MORE = 1_000_000_000


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The small tables with orders' keys beyond those of a hundred times the larger ones."""
    path = tmp_path_factory.mktemp("shifted")
    for name in ("region", "nation", "supplier"):
        shutil.copy(os.path.join(SMALL, f"{name}.parquet"), path)
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        table.withColumn(key, F.col(key) + MORE).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["register_rejected", "register_rows", "register_conflicts", "register_foreign_orgs", "register_agreements", "register_links", "register_entries", "register_search_page"])
def test_register_of_large_keys(spark, shifted, name):
    small, large = registry.QUERIES[name](spark, SMALL), registry.QUERIES[name](spark, shifted)
    assert small.dtypes == large.dtypes
    kept = [c for c in small.columns if c not in ("source_row", "first_row", "agreement_number", "procurement_number")]
    if name == "register_search_page":
        kept = ["framework_area", "total"]
    assert rows(small, *kept) == rows(large, *kept)
    if name == "register_rows":
        assert large.select("source_row").distinct().count() == small.count()


def test_normalize_reads_a_name_once(spark):
    raw = spark.createDataFrame([(1, *["x"] * len(register.RAW))], ["source_row", *register.RAW])
    plan = register.normalize(raw)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(supplier") == 1


def test_prose_facts_of_many_customers(spark, tmp_path):
    """From 89,001 customers on, a customer has the number that a draft of an earlier one calls gone."""
    for name in oracle.TABLES:
        shutil.copy(os.path.join(SMALL, f"{name}.parquet"), tmp_path)
    more = f"SELECT * FROM '{SMALL}/customer.parquet' UNION ALL SELECT * REPLACE (c_custkey + 89000 AS c_custkey) FROM '{SMALL}/customer.parquet'"
    os.remove(tmp_path / "customer.parquet")
    duckdb.connect().execute(f"COPY ({more}) TO '{tmp_path}/customer.parquet'")
    duckdb.connect().execute(f"COPY (SELECT * FROM '{SMALL}/orders.parquet' WHERE o_orderkey % 40 < 8) TO '{tmp_path}/few.parquet'")
    os.replace(tmp_path / "few.parquet", tmp_path / "orders.parquet")
    oracle.same(spark, "check_prose_facts", registry.QUERIES["check_prose_facts"], registry.ORACLE_SQL["check_prose_facts"], str(tmp_path))


def test_iso_dates_are_cast(spark):
    said = ["2024-02-29", " 2024-02-29 ", "2023-02-29", "0001-01-01", "2024-2-9", "2024-01-01\n", "2024-01-01 10:00", "2024-13-01", "", None]
    df = spark.createDataFrame([(s,) for s in said], "s string").select("s", dates.iso_date(F.col("s")).alias("d"))
    assert {r.s: str(r.d) for r in df.collect() if r.d} == {"2024-02-29": "2024-02-29", " 2024-02-29 ": "2024-02-29", "0001-01-01": "0001-01-01"}
    assert "gettimestamp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_page_scopes_read_the_register_once(spark):
    plan = registry.QUERIES["page_scopes"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan


def test_equal_mentions_of_a_file_are_resolved_once(spark):
    found = spark.createDataFrame([(1, 1, "section", "2", "", False), (1, 5, "section", "2", "", True), (2, 7, "section", "2", "", False), (2, 7, "title", "scope of it", "", False)], "doc long, position long, kind string, key string, named string, replaces boolean")
    sections = spark.createDataFrame([(1, 3, "2", "Scope"), (2, 8, "1", "Scope")], "doc long, position long, number string, title string")
    files = spark.createDataFrame([(1, 1, "A", None, "annex"), (1, 2, "B", None, "annex")], "page long, doc long, title string, annex string, document_type string")
    got = references.resolve(found, sections, files)
    want = [(1, 1, False, "resolved", "R1", 1, 3), (1, 5, True, "resolved", "R1", 1, 3), (2, 7, False, "resolved", "R4", 2, 8), (2, 7, False, "unresolved", None, None, None)]
    assert rows(got, "doc", "position", "replaces", "status", "rule", "target_doc", "target_position") == sorted(want, key=repr)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any(" position#" in line or "(position#" in line for line in joins)


def test_spread_by_rows(spark):
    assert common.spread(spark.range(100), 10).rdd.getNumPartitions() == 10


def test_drafts_are_made_once_and_spread(spark, monkeypatch):
    """However few splits and row groups the orders' file has, a task reads few drafts; and no step makes their texts anew."""
    monkeypatch.setattr(prose_queries, "DRAFTS", 100)
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    found = prose_queries._drafts(spark, SMALL)
    sizes = found[0].rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == orders and len(sizes) >= orders / 100 and max(sizes) < 200
    for made in (found[0], found[1], found[3], found[4]):
        assert "parquet" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
