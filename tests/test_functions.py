"""Identifiers, dates, text functions: table-driven cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spandrel.functions import dates, identifiers, text


def one(spark, column, *values):
    """The value of a column function on literals."""
    return spark.range(1).select(column(*[F.lit(v) for v in values]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("5566778899", "556677-8899"), ("SE212000014201", "212000-0142"), ("SE212000014299", "SE212000014299"), ("", None), ("9876", None), ("none", None), ("no:987654321", "NO:987654321")],
)
def test_org_number(spark, raw, wanted):
    assert one(spark, identifiers.normalize_org_number, raw) == wanted


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("23.3.1234-19:045", "23.3-1234-2019-045"), ("23.3-777-2018-09", "23.3-777-2018-009"), ("23.3-5120-2021-012-B", "23.3-5120-2021-012-B"), ("4321/08", "4321/08"), ("23.5-991-2022", "23.5-991-2022"), ("23.3.7.15", None), ("23.1-11.09", None), ("hello", None)],
)
def test_agreement_key(spark, raw, wanted):
    assert one(spark, identifiers.agreement_key, raw) == wanted


def test_agreement_forms(spark):
    split = lambda raw: one(spark, identifiers.split_agreement_number, raw)
    assert tuple(split("23.3-7701-19:014"))[1:] == ("23.3-7701-19", "014")
    assert tuple(split("23.3-8052-2022-011-C"))[1:] == ("23.3-8052-2022", "011-C")
    assert tuple(split("23.4-6120-2021"))[1:] == ("23.4-6120-2021", None)
    assert split("nothing") is None


def test_names_and_paths(spark):
    assert tuple(one(spark, identifiers.supplier_name, " AB  New (f.d. Old AB)")) == ("AB New", "Old AB")
    assert tuple(one(spark, identifiers.supplier_name, "Plain AB")) == ("Plain AB", None)
    assert one(spark, identifiers.sub_area_path, "A / B / C") == ["A", "B", "C"]
    assert one(spark, identifiers.sub_area_path, "A /  / C") is None


def test_find_org_numbers(spark):
    said = "Org 556190-7733, SE 556190-7733 01, person 790412-3456, ring +4612345678, 5560804212, fel 556190-7734"
    assert sorted(one(spark, identifiers.find_org_numbers, said)) == ["556080-4212", "556190-7733", "556190-7733"]


def test_easter(spark):
    found = spark.createDataFrame([(y,) for y in (2024, 2025, 2026, 2027)], "y int").select(dates.easter_sunday(F.col("y"))).collect()
    assert [r[0] for r in found] == [dt.date(2024, 3, 31), dt.date(2025, 4, 20), dt.date(2026, 4, 5), dt.date(2027, 3, 28)]


@pytest.mark.parametrize(
    ("start", "n", "eves_off", "wanted"),
    [("2025-04-14", 5, False, "2025-04-23"), ("2024-12-20", 3, False, "2024-12-27"), ("2024-12-20", 3, True, "2024-12-30"), ("2025-05-02", -2, False, "2025-04-29"), ("2025-06-06", 1, False, "2025-06-09"), ("2025-03-08", 0, False, "2025-03-08")],
)
def test_working_days(spark, start, n, eves_off, wanted):
    df = spark.createDataFrame([(dt.date.fromisoformat(start), n)], "day date, n int")
    assert dates.add_working_days(df, "day", "n", "to", dates.calendar(spark, 2024, 2026), eves_off).first()["to"] == dt.date.fromisoformat(wanted)


def test_shift_units(spark):
    units = {"days": "2025-05-07", "working_days": "2025-05-22", "weeks": "2025-11-03", "months": "2027-10-07", "years": "2055-04-07"}
    df = spark.createDataFrame([(dt.date(2025, 4, 7), 30, u) for u in units], "day date, n int, unit string")
    found = {r["unit"]: str(r["to"]) for r in dates.shift(df, "day", "n", "unit", "to", dates.calendar(spark, 2025, 2056)).collect()}
    assert found == units


def test_thirteen_holidays(spark):
    days = {r["day"] for r in spark.range(1).select(F.explode(dates.holidays(F.lit(2027))).alias("x")).select("x.day").collect()}
    assert len(days) == 13 and {dt.date(2027, 6, 26), dt.date(2027, 11, 6)} <= days


def test_end_outcome(spark):
    date = dt.date.fromisoformat
    cases = [("2025-01-31", None, "2025-01-31", None, "MATCH"), ("2025-01-31", 12, "2026-01-31", None, "EXTENSION_USED"), ("2025-01-31", None, "2025-06-30", "2025-12-31", "EXTENSION_USED"), ("2025-01-31", None, "2025-06-30", None, "DEVIATES")]
    df = spark.createDataFrame([(date(e), m, date(v), x and date(x), w) for e, m, v, x, w in cases], "e date, m int, v date, x date, w string")
    assert df.filter(dates.end_outcome(F.col("e"), F.col("m"), F.col("v"), F.col("x")) != F.col("w")).count() == 0


@pytest.mark.parametrize(("a", "b"), [("avtalet", "avtal"), ("avtalen", "avtal"), ("avtal", "avtal"), ("jaktkarlarne", "jaktkarl"), ("arbetslöst", "arbetslös"), ("viktigt", "vikt"), ("av", "av")])
def test_stem(a, b):
    assert text.stem(a) == b


def test_words_keep_identifiers(spark):
    said = "Avtal 23.3-2649-2022-003 från 2025-08-19, org 556635-9799, avsnitt 6.21.9 IT-drift iso27001"
    assert one(spark, text.words, said) == ["avtal", "23.3-2649-2022-003", "från", "2025-08-19", "org", "556635-9799", "avsnitt", "6.21.9", "it", "drift", "iso27001"]


def test_section_hash_ignores_number(spark):
    h = lambda t, n: one(spark, text.section_hash, t, n)
    assert h("6.1 Vite  gäller", "6.1") == h("7.2. Vite gäller", "7.2")
    assert h("6.17 Vite", "6.1") != h("7 Vite", "7")


def test_quote_form(spark):
    assert one(spark, text.quote_form, " “Ett”  av­ tal – x ") == '"ett" avtal - x'
    assert one(spark, text.trim_quote, '… "ord här" ...') == "ord här"
    assert one(spark, text.markers, "as [2] and [1, 2]") == [1, 2]


def test_number_words(spark):
    assert [one(spark, text.number_of, w) for w in ("tre", "Tjugofem", "99", "hundra")] == [3, 25, 99, None]


@pytest.mark.parametrize(("raw", "wanted"), [("901000/05", "901000/05"), ("96-1234567-2015", "96-1234567-2015"), ("23.3-012345678-2021", "23.3-12345678-2021"), ("23.3.123456789012-20:11", "23.3-123456789012-2020-011")])
def test_agreement_key_of_long_serials(spark, raw, wanted):
    assert one(spark, identifiers.agreement_key, raw) == wanted


def test_excerpt_before_a_final_line_break(spark):
    said = F.lit("aaaa bbbb cccc dddd.\neeee")
    assert one(spark, lambda t: text.excerpt(t, F.lit(5), F.lit(9), 32), said) == "aaaa bbbb cccc dddd. …"


def test_agreement_key_reads_a_number_once(spark):
    """Each part of a number is one expression of the plan: a Column named twice would be read twice."""
    forms = spark.createDataFrame([("23.3.07701-19:14",), ("23.3.12.20",), (None,)], "raw string").select(identifiers.agreement_key(F.col("raw")).alias("key"))
    assert forms._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") < 60
    assert [r.key for r in forms.collect()] == ["23.3-7701-2019-014", None, None]
