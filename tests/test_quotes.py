"""Quotes in pages, and the store of parsed files."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from spandrel.operators import quotes, validation
from spandrel.plans import registry
from spandrel.sources import parsed
from tests import oracle
from tests.conftest import SMALL, rows

LONG = "Leverantören ska betala vite om tio procent av avgiften"
FOUND = [
    ("Vite utgår med 10 – 20 %.", "10-20 %", "full", "10 – 20 %"),
    ("Den ”första” dagen", '"första"', "full", "”första”"),
    ("avﬁlmad", "avfilmad", "full", "avﬁlmad"),
    ("ändrad", "ändrad", "full", "ändrad"),
    ("leve-\nrans av varor", "leverans", "full", "leve-\nrans"),
    ("IT-\nstöd", "IT-stöd", "full", "IT-\nstöd"),
    ("Vite", "vite", "none", ""),
    ("Vite", " \n", "none", ""),
    ("", "Vite", "none", ""),
    (f"Före.\n{LONG}\n", f"{LONG} varje dag som går", "partial", LONG),
    (f"{LONG}\nEfter.", f"Ja. {LONG}", "partial", LONG),
    (f"Före {LONG} mitt i en rad som går vidare", f"{LONG} varje dag", "none", ""),
    (f"Före.\n{LONG}\n" + "x" * 300, f"{LONG} varje dag", "none", ""),
    ("Kort text", "Kort text som går vidare utan att finnas", "none", ""),
]


@pytest.mark.parametrize(("text", "quote", "match", "part"), FOUND)
def test_find(text, quote, match, part):
    kind, start, end = quotes.find(text, quote)
    assert (kind, text[start:end] if start >= 0 else "") == (match, part)


@pytest.mark.parametrize("join_lines", [False, True])
def test_plain_is_folded_text(join_lines):
    for text in ["", "-", "\n", "a- \n-b–\n", "IT-\n\nstöd\u00ad\n“x” ﬁ", "--\n", *[t for pair in FOUND for t in pair[:2]]]:
        assert quotes._plain(text, join_lines) == quotes.folded(text, join_lines)[0]


def test_locate_meets_the_pages_ahead_and_no_others(spark):
    """A quote is asked for in two stretches of pages at most, not once for every page."""
    pages = spark.createDataFrame([("d", n, f"Text på sidan nummer {n}.") for n in range(-3, 40)], "doc string, page int, text string")
    asked = spark.createDataFrame([("d", f"sidan nummer {n + away}.", n) for n in range(-3, 25) for away in (-1, 0, 10, 11)], "doc string, quote string, page int")
    got = quotes.locate(asked, pages)
    wanted = sorted((n, n + away, "full") if away in (0, 10) else (n, n, "none") for n in range(-3, 25) for away in (-1, 0, 10, 11))
    assert sorted((r["page"], r["found_on"], r["match"]) for r in got.collect()) == wanted
    assert "explode(sequence(page" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_locate(spark):
    pages = spark.createDataFrame([("d", 1, LONG), ("d", 2, "Hela citatet här"), ("d", 20, "Hela citatet här"), ("d", 3, None), ("e", 1, "Hela citatet här")], "doc string, page int, text string")
    asked = [("d", "Hela citatet", 1, "a"), ("d", "Hela citatet", 3, "b"), ("d", f"{LONG} varje dag", 1, "c"), ("x", "Hela citatet", 1, "d"), ("d", None, 2, "e"), ("d", "Hela citatet", 1, "f")]
    got = quotes.locate(spark.createDataFrame(asked, "doc string, quote string, page int, start_ string"), pages)
    assert rows(got, "start_", "found_on", "match", "start", "end") == [("a", 2, "full", 0, 12), ("b", 3, "none", -1, -1), ("c", 1, "partial", 0, len(LONG)), ("d", 1, "none", -1, -1), ("e", 2, "none", -1, -1), ("f", 2, "full", 0, 12)]


def test_store_reads_only_what_is_new(spark, tmp_path):
    path, asked = f"file://{tmp_path}/store", []

    def parse(fresh):
        asked.append(sorted(r["sha256"] for r in fresh.collect()))
        return fresh.filter("text <> 'lost'").select("sha256", F.when(F.col("text") == "bad", "broken").alias("error"), F.upper("text").alias("blocks"))

    def run(version, name, texts):
        files = spark.createDataFrame(texts, "sha256 string, text string")
        found = parsed.parse_new(files, parsed.stored(spark, path, "sha256 string, blocks string"), version, parse)
        parsed.add(found, path, version, name)
        asked.pop()
        return rows(parsed.parse_new(files, parsed.stored(spark, path, "sha256 string, blocks string"), version, parse), "sha256", "status", "error", "blocks")

    first = run("v1", "r1", [("a", "x"), ("a", "x"), ("b", "bad"), ("c", "lost")])
    assert first == [("a", "cached", None, "X"), ("b", "failed", "broken", "BAD"), ("c", "failed", "not read", None)] and asked.pop() == ["b", "c"]
    second = run("v1", "r2", [("a", "changed"), ("d", "y")])
    assert second == [("a", "cached", None, "X"), ("d", "cached", None, "Y")]
    asked.clear()
    assert run("v2", "r1", [("a", "z")]) == [("a", "cached", None, "Z")]
    assert rows(parsed.stored(spark, path, "sha256 string, blocks string")) == [("a", "X", "v1"), ("a", "Z", "v2"), ("d", "Y", "v1")]


def test_quoted_equals_all_pairs(spark):
    """Quotes of every length, whose first and last words may be parts of words, against every text."""
    texts = [(1, "The supplier shall pay a penalty of ten per cent of the fee"), (2, "a b c d e f g h i j"), (3, "Fees  are “due” at once"), (4, ""), (5, None), (6, "x")]
    said = ["supplier shall", "plier shall pay a pen", "shall pay a penalty of ten per cent", "b c", "b", "c d e f g h i", "d e f g h j", '"due"', "FEES ARE", "x", "xy", "", None, "e fee", "lier", "b c d"]
    t = spark.createDataFrame(texts, "doc int, text string")
    q = spark.createDataFrame(list(enumerate(said)), "quote_id int, quote string")
    form = lambda x: " ".join(x.replace("“", '"').replace("”", '"').lower().split())
    wanted = sorted(((d, i) for d, x in texts if x is not None for i, s in enumerate(said) if s and form(s) in form(x)), key=repr)
    assert rows(validation.quoted(t, q)) == wanted and len(wanted) > 10
    assert validation.quoted(t, q.filter("false")).count() == 0
    assert validation.quoted(t.filter("false"), q).count() == 0


def test_quotes_that_begin_with_a_full_stop(spark, tmp_path):
    """A quote of the last 14 letters of a text is too short, also with the full stop before them."""
    texts = ["Ered. pathetic loser", "Ered. pathetic losers", ".Von und zu", ". . Von", "....", "Abcd....", "\"Von.\"", "", None]
    for name in oracle.TABLES:
        if name != "documents":
            os.symlink(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(28 * n + i, t) for n, t in enumerate(texts) for i in range(1, 8)])
    con.execute(f"COPY t TO '{tmp_path}/documents.parquet'")
    oracle.same(spark, "citation_problems", registry.QUERIES["citation_problems"], registry.ORACLE_SQL["citation_problems"], str(tmp_path))
