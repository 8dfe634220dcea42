"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value or str(value) in ("NaT", "<NA>"):
        return None
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 7)
    return value.item() if hasattr(value, "item") else value


def table(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def same(spark, name: str, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, wanted = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns), name
    assert table(found) == table(wanted), name
