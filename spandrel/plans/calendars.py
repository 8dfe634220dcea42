"""Queries of the calendar and of date shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import dates
from spandrel.plans.common import query, read

_DAYS = """
years AS (SELECT CAST(y AS INTEGER) AS y FROM unnest(range(1990, 2101)) AS t(y)),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
e2 AS (SELECT *, b // 4 AS d, b % 4 AS e, (b - (b + 8) // 25 + 1) // 3 AS g FROM e1),
e3 AS (SELECT *, (19 * a + b - d - g + 15) % 30 AS h FROM e2),
e4 AS (SELECT *, (32 + 2 * e + 2 * (c // 4) - h - c % 4) % 7 AS m FROM e3),
e5 AS (SELECT y, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS s FROM e4),
easter AS (SELECT y, make_date(y, s // 31, s % 31 + 1) AS d FROM e5),
sat AS (SELECT y, make_date(y, 6, 20) + CAST((13 - isodow(make_date(y, 6, 20))) % 7 AS INTEGER) AS mid, make_date(y, 10, 31) + CAST((13 - isodow(make_date(y, 10, 31))) % 7 AS INTEGER) AS saints FROM years),
hol AS (SELECT make_date(y, 1, 1) AS day, 'nyårsdagen' AS holiday FROM years UNION ALL SELECT make_date(y, 1, 6), 'trettondedag jul' FROM years UNION ALL SELECT d - 2, 'långfredagen' FROM easter
  UNION ALL SELECT d, 'påskdagen' FROM easter UNION ALL SELECT d + 1, 'annandag påsk' FROM easter UNION ALL SELECT make_date(y, 5, 1), 'första maj' FROM years UNION ALL SELECT d + 39, 'Kristi himmelsfärdsdag' FROM easter
  UNION ALL SELECT d + 49, 'pingstdagen' FROM easter UNION ALL SELECT make_date(y, 6, 6), 'Sveriges nationaldag' FROM years UNION ALL SELECT mid, 'midsommardagen' FROM sat UNION ALL SELECT saints, 'alla helgons dag' FROM sat
  UNION ALL SELECT make_date(y, 12, 25), 'juldagen' FROM years UNION ALL SELECT make_date(y, 12, 26), 'annandag jul' FROM years),
named AS (SELECT day, min(holiday) AS holiday FROM hol GROUP BY day),
days AS (SELECT CAST(x AS DATE) AS day FROM unnest(generate_series(DATE '1990-01-01', DATE '2100-12-31', INTERVAL 1 DAY)) AS t(x)),
cal AS (SELECT days.day, holiday, isodow(days.day) < 6 AND holiday IS NULL AS working FROM days LEFT JOIN named ON named.day = days.day)"""


def days(spark: SparkSession) -> DataFrame:
    """The calendar from 1990, as the driver's dates go back to that decade."""
    return dates.calendar(spark, 1990, 2100)


@query(f"WITH {_DAYS} SELECT day, holiday, working, CAST(sum(CASE WHEN working THEN 1 ELSE 0 END) OVER (ORDER BY day) AS BIGINT) AS ordinal FROM cal", dates=("day",))
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day with its holiday, and whether it is a working day."""
    return days(spark).select("day", "holiday", "working", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"""WITH {_DAYS}, w AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM cal WHERE working),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderkey % 61 - 30 AS INTEGER) AS amount FROM orders),
b AS (SELECT o.*, (SELECT max(n) FROM w WHERE w.day <= o.start) AS upto, (SELECT max(n) FROM w WHERE w.day < o.start) AS before FROM o)
SELECT o_orderkey, start, amount, CASE WHEN amount = 0 THEN start ELSE w.day END AS result FROM b LEFT JOIN w ON w.n = CASE WHEN amount > 0 THEN upto + amount ELSE before + 1 + amount END""", dates=("start", "result"))
def working_day_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates moved by working days, forwards and backwards."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start"), (F.col("o_orderkey") % 61 - 30).cast("int").alias("amount"))
    return dates.add_working_days(o, "start", "amount", "result", days(spark))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderkey % 25 - 12 AS INTEGER) AS amount, ['days', 'weeks', 'months', 'years'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS unit FROM orders)
SELECT *, CAST(CASE unit WHEN 'days' THEN start + amount WHEN 'weeks' THEN start + amount * 7 WHEN 'months' THEN start + to_months(amount) ELSE start + to_months(amount * 12) END AS DATE) AS result FROM o""", dates=("start", "result"))
def date_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates moved by days, weeks, months and years."""
    k = F.col("o_orderkey")
    units = F.array(*[F.lit(u) for u in ("days", "weeks", "months", "years")])
    o = read(spark, sf_dir, "orders").select(k, F.col("o_orderdate").cast("date").alias("start"), (k % 25 - 12).cast("int").alias("amount"), F.element_at(units, (k % 4 + 1).cast("int")).alias("unit"))
    return dates.shift(o, "start", "amount", "unit", "result", days(spark))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS stated, CAST(l_shipdate AS DATE) + CAST(l_partkey % 400 - 100 AS INTEGER) AS valid_to,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber * 2 AS INTEGER) END AS months, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_shipdate AS DATE) + 200 END AS extension FROM lineitem),
b AS (SELECT *, CASE WHEN months IS NOT NULL THEN CAST(stated + 1 + to_months(months) AS DATE) - 1 ELSE coalesce(extension, stated) END AS most FROM a)
SELECT l_orderkey, l_linenumber, CASE WHEN stated = valid_to THEN 'MATCH' WHEN stated < valid_to AND valid_to <= most THEN 'EXTENSION_USED' ELSE 'DEVIATES' END AS outcome FROM b""")
def period_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated ends of periods against the register's."""
    n, ship = F.col("l_linenumber"), F.col("l_shipdate").cast("date")
    outcome = dates.end_outcome(ship, F.when(n % 2 == 0, n * 2), F.date_add(ship, (F.col("l_partkey") % 400 - 100).cast("int")), F.when(n % 3 == 0, F.date_add(ship, 200)))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", n, outcome.alias("outcome"))
