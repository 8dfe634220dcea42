"""Register values in prose: the scan with its places, and what is and isn't backed."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from spandrel.functions import dates, spans
from spandrel.operators import prose

A, B = "23.3-4100-2024-001", "23.3-4100-2024-002"
REGISTER = [
    (A, "Nordfjäll Data AB", ["Gamla Fjäll AB"], "556080-4212", date(2024, 11, 14), date(2028, 11, 13), date(2030, 11, 13)),
    (B, "Sydvik AB", [], "556190-7733", date(2025, 1, 1), date(2027, 2, 17), None),
    ("23.3-4100-2024-005", "Ö Oy", [], "FI12345678", date(2025, 1, 1), date(2027, 2, 17), None),
]
TODAY = date(2026, 3, 2)
#: (text, declared numbers, passage, problems as (raw, problem, due))
CASES = {
    "right": (f"Avtal {A} gäller 2024-11-14–2028-11-13 och leverantören har nummer 556080-4212.", [A], None, []),
    "other spelling": ("Avtal 23.3.4100-24:001 gäller till 13 november 2028.", [A], None, []),
    "short form": ("Avtalen 23.3-4100-2024-001 och -002 gäller.", [A, B], None, []),
    "undeclared short form": ("Avtalen 23.3-4100-2024-001 och -007 gäller.", [A], None, [("23.3-4100-2024-007", "unbacked", None)]),
    "short form of no number": ("Det kostar -007 och 08-700.", [], None, []),
    "short form in another sentence": (f"Se {A}. Även -007 gäller.", [A], None, []),
    "range": ("Avtalen 23.3-4100-2024-001 till -005 gäller.", [A, B, "23.3-4100-2024-005"], None, []),
    "procurement": ("Upphandlingen 23.3-4100-2024 omfattar flera avtal, bland dem Sydviks.", [B], None, []),
    "other procurement": (f"Upphandlingen 23.3-4199-2024 gäller, liksom {A}.", [A], None, [("23.3-4199-2024", "unbacked", None)]),
    "malformed": (f"Avtal 23.3-4100-2024-0021 gäller, liksom {A}.", [A], None, [("23.3-4100-2024-0021", "malformed", None)]),
    "sections": (f"Se 6.21.9, 23.1-23.12 och 23.1.10-23.1.12 i {A}.", [A], None, []),
    "check digit": (f"Avtal {A} har 556080-4219.", [A], None, [("556080-4219", "check_digit", None)]),
    "vat number": (f"Avtal {A} har SE556080421201.", [A], None, []),
    "of another": (f"Avtal {A} har 556190-7733. Sydvik AB har 556190-7733.", [A, B], "Sydvik har 556190-7733", [("556190-7733", "not_of_named", None)]),
    "by former name": ("Gamla Fjälls avtal gäller till 2027-02-17. Sydvik gäller till 2027-02-17.", [A, B], None, [("2027-02-17", "not_of_named", None)]),
    "no such day": (f"Avtal {A} gäller till 2028-02-30.", [A], None, [("2028-02-30", "no_such_day", None)]),
    "passage": (f"Avtal {A} har pris till den 1 maj 2026.", [A], "Priserna gäller till 2026-05-01.", []),
    "today": (f"Avtal {A} gällde 2026-03-02.", [A], None, []),
    "unbacked": (f"Avtal {A} gäller. Det prövas 2029-05-05.", [A], None, [("2029-05-05", "unbacked", None)]),
    "offset": (f"Avtal {B} gäller till 2027-02-17. Säg upp det tre (3) månader före, 2026-11-17.", [B], None, []),
    "offset by word": (f"Avtal {B} gäller. Tjugofyra månader efter 2027-02-17 är 2029-02-17.", [B], None, []),
    "working days": (f"Avtal {B} gäller. Tio (10) arbetsdagar efter 2027-02-17 är 2027-03-03.", [B], None, []),
    "near miss": (f"Avtal {A} gäller i fyra år, 2024-11-14–2028-11-14.", [A], None, [("2028-11-14", "not_of_named", None)]),
    "calculation": (f"Avtal {A}: 2024-11-14 plus 4 år = 2028-11-14, minus 1 dag = 2028-11-13.", [A], None, []),
    "wrong calculation": (f"Avtal {B}: 2027-02-17 minus 3 månader = 2026-11-17, minus 10 dagar = 2026-11-08, minus 1 dag = 2026-11-07.", [B], None, [("2026-11-08", "calculation", date(2026, 11, 7)), ("2026-11-07", "not_of_named", None)]),
    "steps from the first": (f"Avtal {B}: 2027-02-17 minus 3 månader = 2026-11-17, minus 6 månader = 2026-08-17.", [B], None, []),
    "chained": (f"Avtal {B}: 2026-08-17 minus 1 vecka = 2026-08-10. Det är räknat från 2027-02-17 minus 6 månader = 2026-08-17.", [B], None, []),
    "from nothing": (f"Avtal {B}. Det är 2031-01-01 plus 1 dag = 2031-01-02.", [B], None, [("2031-01-01", "unbacked", None), ("2031-01-02", "unbacked", None)]),
    "unused": (f"Avtal {A} gäller.", [A, B], None, [(B, "unused", None)]),
    "used by number": ("Företaget 556190-7733 har avtal.", [B], None, []),
    "used by spelling": ("Företaget FI12345678 har avtal.", ["23.3-4100-2024-005"], None, []),
    "unknown": ("Avtal 23.3-9999-2024-001 gäller.", ["23.3-9999-2024-001"], None, [("23.3-9999-2024-001", "unknown", None)]),
    "not a number": ("Avtal gäller.", ["avtalet"], None, [("avtalet", "not_a_number", None)]),
    "nothing": ("", [], None, []),
    "null": (None, [A], None, []),
}


@pytest.fixture(scope="module")
def problems(spark):
    drafts = spark.createDataFrame([(n, c[0]) for n, c in CASES.items()], "draft string, text string")
    declared = spark.createDataFrame([(n, x) for n, c in CASES.items() for x in c[1] if c[0] is not None] + [("right", None)], "draft string, number string")
    passages = spark.createDataFrame([(n, c[2]) for n, c in CASES.items()], "draft string, text string")
    register = spark.createDataFrame(REGISTER, "agreement_number string, supplier_name string, former_names array<string>, org_number string, valid_from date, valid_to date, max_extension_to date")
    found: dict = {}
    for r in prose.register_prose(drafts, declared, register, passages, dates.calendar(spark), F.lit(TODAY)).collect():
        found.setdefault(r["draft"], []).append(r)
    return found


@pytest.mark.parametrize("name", CASES)
def test_problems(problems, name):
    got = problems.get(name, [])
    assert sorted([(r["raw"], r["problem"], r["due"]) for r in got], key=repr) == sorted(CASES[name][3], key=repr)


def test_places(problems):
    for name, found in problems.items():
        for r in found:
            if r["at"] is not None and r["raw"] in CASES[name][0]:
                assert CASES[name][0][r["at"] :].startswith(r["raw"])


def test_no_drafts(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    register = none("agreement_number string, supplier_name string, former_names array<string>, org_number string, valid_from date, valid_to date, max_extension_to date")
    got = prose.register_prose(none("draft long, text string"), none("draft long, number string"), register, none("draft long, text string"), dates.calendar(spark), F.lit(TODAY))
    assert got.count() == 0


def test_spans_and_claims(spark):
    df = spark.createDataFrame([("a1bc22d333",), ("22",), ("x",), ("",), (None,), ("å1 𝄞2",)], "t string")
    got = {r["t"]: ([tuple(s) for s in r["s"]], r["c"]) for r in df.select("t", spans.spans(F.col("t"), "[0-9]+").alias("s"), spans.claimed(F.col("t"), "[0-9]+", lambda m: F.length(m) > 1, "_").alias("c")).collect()}
    assert got["a1bc22d333"] == ([(1, 2, "1"), (4, 6, "22"), (7, 10, "333")], "a1bc__d___")
    assert got["22"] == ([(0, 2, "22")], "__") and got["x"] == ([], "x") and got[""] == ([], "") and got[None] == ([], None)
    assert got["å1 𝄞2"] == ([(1, 2, "1"), (4, 5, "2")], "å1 𝄞2")


def test_sentences(spark):
    said = "Ett. Två nr. Tre och IT 3. Fyra f.d. Fem\nSex? Sju"
    got = prose.scan(spark.createDataFrame([(1, said)], "draft int, text string")).first()["sentences"]
    assert [s["said"] for s in got] == ["Ett.", "Två nr. Tre och IT 3. Fyra f.d. Fem", "Sex?", "Sju"]
    assert all(said[s["start"] : s["end"]] == s["said"] for s in got)
