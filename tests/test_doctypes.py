"""Types, annex numbers, chapters, covers and dates of documents."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from spandrel.operators import doctypes
from tests.conftest import rows

LINKS = [
    (("Ramavtal", "https://x/a.pdf", None, "23.3-1-2024-001"), "R01"),
    (("Fragor-svar", None, None, None), "R02"),
    (("Volymavtal", "https://x/a/tillaggsavtal-nr-7.pdf", None, ""), "R04"),
    (("Volymavtal", "https://x/a/fil.pdf?bilaga", None, None), "R05"),
    (("Volymavtal", "https://x/Fil-Bilaga%201.pdf", "Avtal", None), "F1"),
    (("IBM Användningsvillkor-Allmänna  villkor", None, None, None), "R06"),
    (("allmänna\nvillkor", None, None, None), "R07"),
    (("Allmänna villkoren", None, "Upphandling", None), "F2"),
    (("Avropsrutin och vägledning", None, None, None), "R11b"),
    (("Bilagor", None, " Stöddokument och länkar ", None), "F3"),
    ((None, None, None, None), "none"),
]


def test_types(spark):
    data = [(i, *link) for i, (link, _) in enumerate(LINKS)] + [(100, "Bilaga 1", None, None, None), (100, "Prisbilaga", None, None, None)]
    got = {r["sha256"]: (r["document_type"], r["type_rule"]) for r in doctypes.classify(spark.createDataFrame(data, "sha256 int, title string, url string, category string, agreement_number string")).collect()}
    assert [got[i][1] for i in range(len(LINKS))] == [rule for _, rule in LINKS]
    assert got[100] == ("price_annex", "R08") and got[10] == ("unknown", "none")


@pytest.mark.parametrize(("kind", "group"), [("annex", "agreement"), ("questions_and_answers", "procurement"), ("template", "support"), ("unknown", None)])
def test_groups(spark, kind, group):
    assert spark.range(1).select(doctypes.group_of(F.lit(kind)).alias("g")).first()["g"] == group


def test_annexes_and_chapters(spark):
    links = [("a", "Bilaga 4.1 Avtal", "https://x/bilaga-9.pdf"), ("b", "PA Attachment", "https://x/y/volymavtal-bilaga-5.2--z.pdf"), ("c", "Bilagan 3", "https://x/bilaga.pdf"), ("d", None, None)]
    assert rows(doctypes.annex_numbers(spark.createDataFrame(links, "sha256 string, title string, url string"))) == [("a", "4.1"), ("b", "5.2")]
    sections = [("a", 1, None), ("a", 2, "9.1"), ("a", 3, "10"), ("b", 1, "1"), ("c", 1, "A.1"), ("d", 1, None)]
    assert rows(doctypes.first_chapters(spark.createDataFrame(sections, "doc string, position int, number string"))) == [("a", 9)]


def test_file_names(spark):
    urls = ["https://x.se/a/B%C3%A4st%201.PDF?q=/z#/y", "/a/b+c.pdf", "https://x.se/", "x%zz.pdf", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r["n"] for r in df.orderBy("i").select(doctypes.file_name(F.col("u")).alias("n")).collect()] == ["bäst 1.pdf", "b+c.pdf", "", "x%zz.pdf", None]


def test_dates(spark):
    blocks = [
        ("cover", 0, "title", "Upphandlingsdokument"), ("cover", 1, "text", "2024-09-25"), ("cover", 2, "page_header", "2024-01-01"),
        ("late", *(0, "text", "x")), *[("late", i, "text", "x") for i in range(1, 6)], ("late", 6, "text", "Ramavtal 2024-09-27"),
        ("stamp", 0, "text", "Inbjudan 2023-10-03"), ("stamp", 1, "page_header", "23.3 Publicerad 2023-09-04 13:44 Sista dag 2023-12-01 23:59"), ("stamp", 2, "page_header", "publicerad 2023-09-06 10:00"),
        ("third", 0, "page_header", "Version 3: publicerad 2024-11-19 11:47"), ("signed", 0, "text", "den 2024-02-30 eller 2024-03-01, 2024-01-01"), ("none", 0, "text", None),
    ]
    b = spark.createDataFrame(blocks, "sha256 string, position int, kind string, text string")
    links = spark.createDataFrame([("signed", "https://x/y-2020-01-01.pdf"), ("named", "https://x/a-annonserat-2024-09-24_20240925-230101.pdf"), ("none", "https://x/version-1.020304.pdf")], "sha256 string, url string")
    signed = spark.createDataFrame([("signed", date(2024, 5, 1)), ("signed", date(2024, 5, 3)), ("none", None)], "sha256 string, day date")
    assert rows(doctypes.version_dates(b, links, signed)) == [("cover", date(2024, 9, 25), "tendsign_cover"), ("named", date(2024, 9, 25), "file_name"), ("signed", date(2024, 5, 3), "signed"), ("stamp", date(2023, 9, 6), "tendsign_published"), ("third", date(2024, 11, 19), "tendsign_published")]
    assert rows(doctypes.published_on(b)) == [("cover", date(2024, 9, 25)), ("late", date(2024, 9, 27)), ("signed", date(2024, 3, 1)), ("stamp", date(2023, 9, 4))]
    assert doctypes.version_dates(b.filter("false"), links.filter("false"), signed.filter("false")).count() == 0
