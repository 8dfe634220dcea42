"""The cascade of reference rules, rule by rule, and headings by the outline against plain Python."""

import random
from datetime import date

import pytest

from spandrel.operators import cascade
from tests.conftest import rows

FILES = [
    (1, "questions_and_answers", None, None),
    (2, "procurement_document", None, date(2024, 1, 1)),
    (3, "procurement_document", None, date(2024, 2, 1)),
    (4, "amendment", None, None),
    (5, "annex", "5.1", None),
    (6, "annex", "5.2", None),
    (7, "general_terms", None, None),
    (8, "requirements", None, None),
    (9, "supplier_agreement", None, None),
    (10, "requirements", None, None),
    (11, "licence_terms", None, None),
]
LINKS = [
    ("p", 1, "Frågor och svar - Anbudsinbjudan"), ("p", 2, "Utkast till  Anbudsinbjudan"), ("p", 3, "Ansökningsinbjudan"), ("p", 4, "Tillägg till bilagorna 5.1-5.2"), ("p", 5, "Bilaga 5.1 Registrering"), ("p", 6, "Bilaga 5.2 Datadelnings-avtal"),
    ("p", 7, "Allmänna villkor"), ("q", 7, "Allmänna villkor"), ("p", 8, "Kravkatalog"), ("q", 10, "Kravkatalogen version 2"), ("p", 9, "Ramavtal Ett"), ("q", 11, "Villkor"), ("q", 1, "Frågor och svar"),
]
SECTIONS = [
    # doc, position, number, title, level, text
    (1, 1, "1", "Publik fråga 1", 1, "Datum: 2024-01-15 10:00 och 2024-03-01 11:00"), (1, 2, "2", "Publik fråga 2", 1, "Datum: 2023-12-24 10:00"), (1, 3, "3", "Publik fråga 3", 1, "Utan datum"), (1, 4, "4", "Publik fråga 4", 1, "2024-06-01 08:30"),
    (2, 1, "6", "Utkast Allmänna villkor", 1, ""), (2, 2, "6.1", "Vite", 2, ""), (2, 3, "7", "Leverans", 1, ""), (3, 1, "7", "Leverans.", 1, ""), (3, 2, "8", "Pris", 1, ""),
    (4, 1, None, "Ändringar", 1, ""), (5, 1, "2", "Avgift", 1, ""), (5, 2, "3", "Övrigt", 1, ""), (6, 1, "2", "Avgift", 1, ""), (6, 2, "9", "Övrigt om avgift", 1, ""),
    (7, 1, "9", "Vite", 1, ""), (7, 2, "9.7", "Vite", 2, ""), (7, 3, "9.7.8", "Tvist", 3, ""), (7, 4, "9.11", "Tvist", 2, ""), (7, 5, "9.11.3", "Tvist", 3, ""), (7, 6, "2", "Tvist", 1, ""), (7, 7, "9.11.9", "Parter", 3, ""), (7, 8, "5", "Parter", 1, ""), (7, 9, None, "Allmänt", 1, ""),
    (8, 1, "8", "Hållbarhet", 1, ""), (10, 1, "8", "Hållbarhet", 1, ""), (9, 1, "1", "Parter", 1, ""),
]
CASES = [
    # mention, (status, rule, [(page, doc, position)] or number of targets)
    ((7, 1, "section", "9.7", ""), ("resolved", "R1", [(None, 7, 2)])),
    ((7, 1, "section", "4", ""), ("number_missing", "R1", 0)),
    ((1, 2, "section", "7", ""), ("ambiguous", "R1q", 2)),  # both came out after the question
    ((1, 1, "section", "7", ""), ("resolved", "R1q", [(None, 2, 3)])),
    ((1, 1, "section", "8", ""), ("resolved", "R1q", [(None, 3, 2)])),
    ((1, 1, "section", "99", ""), ("number_missing", "R1q", 0)),
    ((1, 4, "title", "leverans av varor", ""), ("resolved", "R4q", [(None, 2, 3)])),
    ((1, 1, "title", "hållbarhet.", ""), ("resolved", "R4p", [("p", 8, 1), ("q", 10, 1)])),
    ((1, 4, "section", "7", ""), ("resolved", "R1q", [(None, 2, 3)])),
    ((1, 3, "title", "pris", ""), ("resolved", "R4q", [(None, 3, 2)])),
    ((4, 1, "section", "2a", ""), ("ambiguous", "R1a", 2)),
    ((4, 1, "section", "3", ""), ("resolved", "R1a", [(None, 5, 2)])),
    ((4, 1, "title", "övrigt om avgift och annat", ""), ("resolved", "R4a", [(None, 6, 2)])),
    ((4, 1, "title", "parter", ""), ("ambiguous", "R4p", 3)),
    ((7, 7, "title", "tvist ska lösas", ""), ("resolved", "R4", [(None, 7, 4)])),
    ((7, 3, "title", "tvist", ""), ("resolved", "R4", [(None, 7, 3)])),
    ((7, 8, "title", "tvist", ""), ("ambiguous", "R4", 4)),
    ((7, 9, "title", "vitet", ""), ("title_missing", "R4", 0)),
    ((7, 9, "title", "hållbarhet", ""), ("resolved", "R4p", [("p", 8, 1), ("q", 10, 1)])),
    ((8, 1, "annex", "5.1", ""), ("resolved", "R3", [(None, 5, None)])),
    ((5, 1, "annex", "5.1", ""), ("self", "R3", 1)),
    ((8, 1, "annex", "5", ""), ("not_published", "R3", 0)),
    ((11, 1, "annex", "5.1", ""), ("not_published", "R3", 0)),
    ((8, 1, "annex_name", "allmänna villkor för alla", ""), ("resolved", "R5", [(None, 7, None)])),
    ((8, 1, "annex_name", "priser", ""), ("not_published", "R5", 0)),
    ((7, 1, "annex_name", "allmänna villkor", ""), ("self", "R5", 1)),
    ((7, 1, "document", "kravkatalog", ""), ("resolved", "R2", [("p", 8, None), ("q", 10, None)])),
    ((7, 1, "document", "allmänna villkor", ""), ("self", "R2", 1)),
    ((2, 1, "document", "allmänna villkor", ""), ("resolved", "R2", [(None, 2, 1)])),
    ((9, 1, "document", "huvuddokument", ""), ("self", "R2", 1)),
    ((1, 1, "document", "upphandlingsdokumenten", ""), ("resolved", "R2", [(None, 2, None)])),
    ((1, 4, "document", "upphandlingsdokumenten", ""), ("ambiguous", "R2", 2)),
    ((8, 1, "document", "prisbilaga", ""), ("not_published", "R2", 0)),
    ((8, 1, "section", "9.7", "allmänna villkor"), ("resolved", "R1x", [(None, 7, 2)])),
    ((8, 1, "section", "6.1", "allmänna villkor"), ("resolved", "R1x", [(None, 2, 2)])),
    ((2, 1, "section", "6.1", "allmänna villkor"), ("resolved", "R1x", [(None, 2, 2)])),
    ((7, 1, "section", "2", "allmänna villkor"), ("resolved", "R1x", [(None, 7, 6)])),
    ((8, 1, "section", "77", "allmänna villkor"), ("number_missing", "R1x", 0)),
    ((8, 1, "section", "77", "prisbilaga"), ("not_published", "R1x", 0)),
    ((1, 1, "question", "2", ""), ("resolved", "RQ", [(None, 1, 2)])),
    ((1, 1, "question", "77", ""), ("number_missing", "RQ", 0)),
    ((1, 1, "law", "2016:1145", ""), ("external", None, 0)),
    ((1, 1, "placeholder", "[x]", ""), ("placeholder", None, 0)),
]


@pytest.fixture(scope="module")
def resolved(spark):
    mentions = [c[0] for c in CASES]
    m = spark.createDataFrame([*mentions, mentions[0]], "doc long, position long, kind string, key string, named string")
    s = spark.createDataFrame(SECTIONS, "doc long, position long, number string, title string, level int, text string")
    links = spark.createDataFrame(LINKS, "page string, doc long, title string")
    f = spark.createDataFrame(FILES, "doc long, document_type string, annex_number string, published_on date")
    found: dict = {}
    for r in cascade.resolve(m, s, links, f).collect():
        found.setdefault(tuple(r[:5]), []).append(r)
    return found


def test_every_mention_has_an_outcome(resolved):
    assert set(resolved) == {c[0] for c in CASES}
    assert {c[1][1] for c in CASES} >= {"R1", "R1x", "R1q", "R1a", "R2", "R3", "R4", "R4q", "R4a", "R4p", "R5", "RQ"}


@pytest.mark.parametrize(("mention", "wanted"), CASES, ids=lambda c: " ".join(map(str, c)) if len(c) == 5 else "")
def test_rule(resolved, mention, wanted):
    got = resolved[mention]
    status, rule, targets = wanted
    assert {(r["status"], r["rule"]) for r in got} == {(status, rule)}
    if isinstance(targets, list):
        assert sorted(((r["page"], r["target_doc"], r["target_position"]) for r in got), key=repr) == sorted(targets, key=repr)
    else:
        assert [r["targets"] for r in got] == [targets]


def test_no_rows(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    got = cascade.resolve(none("doc long, position long, kind string, key string, named string"), none("doc long, position long, number string, title string, level int, text string"), none("page string, doc long, title string"), none("doc long, document_type string, annex_number string, published_on date"))
    assert got.count() == 0


def test_nearest_in_outline_equals_plain_python(spark):
    """Random outlines with many equal headings: the longest shared beginning of the numbers, then the smallest level."""
    rng = random.Random(7)
    sections = []
    for doc in range(4):
        for position in range(40):
            parts = [str(rng.randint(1, 3)) for _ in range(rng.randint(1, 4))]
            sections.append((doc, position, rng.choice([".".join(parts), ".".join(parts), None]), len(parts), rng.choice("abc")))

    def plain(doc, number, head):
        own = number.split(".") if number else []
        shared = {}
        for d, p, n, level, h in sections:
            if (d, h) == (doc, head):
                other = n.split(".") if n else []
                shared[p] = (next((k for k, (x, y) in enumerate(zip(own, other, strict=False)) if x != y), min(len(own), len(other))), level)
        most = max(k for k, _ in shared.values())
        near = {p: level for p, (k, level) in shared.items() if k == most} if most else None
        found = [p for p, level in near.items() if level == min(near.values())] if near else list(shared)
        return len(found), min(found)

    headings = spark.createDataFrame(sections, "doc long, position long, number string, level int, head string")
    asked = headings.select("doc", "position", "number", "head")
    got = cascade.nearest_in_outline(asked, headings)
    wanted = sorted(((d, p, *plain(d, n, h)) for d, p, n, _, h in sections), key=repr)
    assert rows(got.selectExpr("doc", "position", "n", "t.position_")) == wanted


def test_mentions_that_differ_in_position_are_resolved_once(spark, monkeypatch):
    cut, sizes = cascade.cut, []

    def counted(df):
        found = cut(df)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(cascade, "cut", counted)
    many = 30
    sections = spark.createDataFrame([(7, i, "1", "Vite", 1, "") for i in range(many)], "doc long, position long, number string, title string, level int, text string")
    mentions = spark.createDataFrame([(7, i, kind, key, "") for i in range(many) for kind, key in (("title", "vite"), ("section", None))], "doc long, position long, kind string, key string, named string")
    links = spark.createDataFrame([("p", 7, "Allmänna villkor")], "page string, doc long, title string")
    files = spark.createDataFrame([(7, "general_terms", None, None)], "doc long, document_type string, annex_number string, published_on date")
    got = cascade.resolve(mentions, sections, links, files)
    assert rows(got, "position", "kind", "status", "targets", "target_position") == sorted([(i, "title", "ambiguous", many, 0) for i in range(many)] + [(i, "section", "number_missing", 0, None) for i in range(many)], key=repr)
    assert max(sizes) < 5
