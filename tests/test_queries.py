"""Every query runs; those with SQL give what DuckDB gives."""

import pytest

from spandrel.plans import registry
from tests.conftest import SMALL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    same(spark, name, registry.QUERIES[name], registry.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
