"""Stated periods against the register's: statements, what they are compared with, and outcomes."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from spandrel.operators import validation
from tests.conftest import rows

D = date
OUTCOMES = [
    # starts, ends, extension months, longest extension, outcome; the register: 2022-01-01 to 2025-12-31
    ([D(2022, 1, 1)], [D(2025, 12, 31)], None, None, "MATCH"),
    ([], [D(2025, 12, 31)], None, None, "MATCH"),
    ([D(2022, 1, 1)], [], None, None, "MATCH"),
    ([D(2022, 1, 2)], [D(2025, 12, 31)], None, None, "DEVIATES"),
    ([D(2021, 12, 1)], [D(2025, 12, 31)], None, None, "LATER_START"),
    ([D(2022, 1, 1)], [D(2023, 12, 31)], 24, None, "EXTENSION_USED"),
    ([D(2022, 1, 1)], [D(2023, 12, 31)], 23, None, "DEVIATES"),
    ([D(2022, 1, 1)], [D(2023, 12, 31)], None, D(2025, 12, 31), "EXTENSION_USED"),
    ([D(2022, 1, 1)], [D(2023, 12, 31)], None, None, "DEVIATES"),
    ([D(2022, 1, 1)], [D(2026, 12, 31)], 24, D(2027, 12, 31), "DEVIATES"),
    ([D(2021, 1, 1)], [D(2026, 12, 31)], None, None, "DEVIATES"),
    ([D(2021, 1, 1)], [D(2023, 12, 31)], 24, None, "LATER_START"),
]


@pytest.mark.parametrize(("starts", "ends", "months", "longest", "wanted"), OUTCOMES)
def test_outcome(spark, starts, ends, months, longest, wanted):
    df = spark.createDataFrame([(starts, ends, months, D(2022, 1, 1), D(2025, 12, 31), longest)], "starts array<date>, ends array<date>, m int, f date, t date, x date")
    got = df.select(validation.period_outcome(F.col("starts"), F.col("ends"), F.col("m"), F.col("f"), F.col("t"), F.col("x")).alias("o")).first()["o"]
    assert got == wanted


def test_statements(spark):
    facts = [
        ("a", 1, "start", D(2022, 12, 1), None, "s"), ("a", 1, "length", None, 24, "s"), ("a", 2, "end", D(2025, 1, 31), None, None), ("a", 2, "length", None, 12, None), ("a", 2, "extension", None, 6, None),
        ("a", 3, "length", None, 48, None), ("a", None, "extension", None, 36, None), ("b", 1, "start", D(2022, 1, 1), None, None), ("c", 1, "signed", D(2022, 1, 1), None, None),
    ]
    df = spark.createDataFrame(facts, "sha256 string, statement int, kind string, day date, months int, scope string")
    assert rows(validation.stated_periods(df)) == [("a", 1, "s", [D(2022, 12, 1)], [D(2024, 11, 30)], 36), ("a", 2, None, [], [D(2025, 1, 31)], 6), ("b", 1, None, [D(2022, 1, 1)], [], None)]
    assert validation.stated_periods(df.filter("false")).count() == 0


def test_what_statements_are_compared_with(spark):
    s = spark.createDataFrame([(x, 1, scope, [D(2022, 1, 1)], [], None) for x, scope in [("card", None), ("shared", None), ("area", "3. IT"), ("name", "möbler"), ("apart", None), ("alone", None)]], "sha256 string, statement int, scope string, starts array<date>, ends array<date>, extension_months int")
    cards = spark.createDataFrame([("card", "23.3-100-2022-01"), ("card", "23.3-100-2022-001"), ("alone", "23.3-999-2022-001")], "sha256 string, agreement_number string")
    agreements = spark.createDataFrame([("23.3-100-22:001", D(2022, 1, 1), D(2024, 1, 1), None), ("23.3-100-2022-001", D(2022, 2, 1), D(2025, 1, 1), D(2027, 1, 1))], "agreement_number string, valid_from date, valid_to date, max_extension_to date")
    links = spark.createDataFrame([("card", "p", "x"), ("shared", "p", "3. IT-drift"), ("shared", "q", "13. Drift"), ("area", "p", "3. IT-drift"), ("area", "r", "13. Drift"), ("name", "r", "Möbler och inredning"), ("name", "p", "Annat"), ("apart", "p", "x"), ("apart", "r", "y")], "sha256 string, page string, page_title string")
    same, other = (D(2020, 1, 1), D(2023, 1, 1), None), (D(2021, 1, 1), D(2023, 1, 1), None)
    areas = spark.createDataFrame([("p", *same), ("q", *same), ("r", *other)], "page string, valid_from date, valid_to date, max_extension_to date")
    got = validation.compared_periods(s, cards, agreements, links, areas)
    assert rows(got, "sha256", "subject", "valid_from", "valid_to", "max_extension_to") == [
        ("area", "3. IT-drift", *same),
        ("card", "23.3-100-2022-001", D(2022, 1, 1), D(2025, 1, 1), D(2027, 1, 1)),
        ("name", "Möbler och inredning", *other),
        ("shared", "2 pages", *same),
    ]
