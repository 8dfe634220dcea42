"""Outlines, contents, list markers, uploads and texts that are alike, against plain Python."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spandrel.operators import outlines
from tests.conftest import rows

STEPS = [
    ((6, 6), (6, 6, 1), False, 0.0),
    ((6, 6, 8), (6, 6, 9), False, 0.0),
    ((6, 6, 8), (6, 7), False, 0.0),
    ((6, 6, 8), (7,), False, 0.0),
    ((6, 2), (6, 4), False, 0.75),
    ((6,), (6, 1, 1), False, 1.0),
    ((1,), (9,), False, 2.25),
    ((2,), (2, 5, 1), False, 4 * 0.75 - 0.75 + 1.0),
    ((1, 3), (2, 4), True, 3.25),
    ((1, 3), (2, 4), False, None),
    ((6, 6), (6, 6), False, None),
    ((6, 6), (6,), False, None),
    ((6, 6), (5,), False, None),
    ((6,), (6, 1, 1, 1, 1), False, None),
    ((), (3, 1), False, 2.5),
]


@pytest.mark.parametrize(("before", "number", "listed", "cost"), STEPS)
def test_steps(before, number, listed, cost):
    assert outlines.step_cost(before, number, listed) == cost


def test_steps_as_columns(spark):
    rng = random.Random(1)
    some = lambda: tuple(rng.randint(1, 4) for _ in range(rng.randint(0, 5)))
    pairs = [(i, some(), some() or (1,), rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame([(i, list(a), list(b), c) for i, a, b, c in pairs], "i int, a array<int>, b array<int>, c boolean")
    got = {r["i"]: r["x"] for r in df.select("i", outlines.step_cost_column(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()}
    assert got == {i: outlines.step_cost(a, b, c) for i, a, b, c in pairs}


def every_chain(numbers, scores, listed):
    """The best value over all chains, by trying them."""
    best = float("-inf")

    def grow(last, value):
        nonlocal best
        best = max(best, value)
        for j in range(last + 1, len(numbers)):
            cost = outlines.step_cost(numbers[last], numbers[j], listed[j])
            if cost is not None:
                grow(j, value + scores[j] - cost)

    for i, n in enumerate(numbers):
        grow(i, scores[i] - (len(n) - 1))
    return best


def test_best_chain_equals_all_chains():
    rng = random.Random(2)
    for _ in range(60):
        numbers = [tuple(rng.randint(1, 3) for _ in range(rng.randint(1, 3))) for _ in range(9)]
        scores, listed = [rng.choice([0.5, 1.0, 1.5, 2.5]) for _ in numbers], [False] * 9
        chain = outlines.best_chain(numbers, scores, listed)
        value = scores[chain[0]] - (len(numbers[chain[0]]) - 1) + sum(scores[b] - outlines.step_cost(numbers[a], numbers[b]) for a, b in zip(chain, chain[1:], strict=False))
        assert value == pytest.approx(every_chain(numbers, scores, listed))
    assert outlines.best_chain([], []) == []


def test_contents_outweigh_quoted_numbers():
    numbers = [(4,), (5,), *[(4, 6, k) for k in range(1, 7)], (6,)]
    listed = [n in [(4,), (5,), (6,)] for n in numbers]
    assert [numbers[i] for i in outlines.best_chain(numbers, [2.5 if on else 2.0 for on in listed], listed)] == [(4,), (5,), (6,)]


CONTENTS = {
    "counted back": ([(2,), None, None, (2, 2, 1)], [(2,), (2, 1), (2, 2), (2, 2, 1)]),
    "with the chapter": ([(3, 7, 12), None, None, None, (4, 2, 1)], [(3, 7, 12), (4,), (4, 1), (4, 2), (4, 2, 1)]),
    "does not fit": ([(2,), None, None, (2, 3, 1)], [(2,), None, None, (2, 3, 1)]),
    "other runs at that level": ([(1,), None, None, (2,), None, (2, 1, 1), (3,), None], [(1,), (1, 1), (1, 2), (2,), (2, 1), (2, 1, 1), (3,), (3, 1)]),
    "nothing known": ([(1,), None, (2,)], [(1,), None, (2,)]),
    "at the start": ([None, (1,), (1, 1)], [None, (1,), (1, 1)]),
    "none": ([None, None], [None, None]),
    "below one": ([(1,), None, None, None, None, (1, 2, 1)], [(1,), None, None, None, None, (1, 2, 1)]),
}


def test_infer_numbers(spark):
    data = [(doc, i, list(n) if n else None, "title") for doc, (given, _) in CONTENTS.items() for i, n in enumerate(given)]
    got = outlines.infer_numbers(spark.createDataFrame(data, "doc string, position int, number array<int>, level_ string"))
    assert got.columns == ["doc", "position", "number", "level_"]
    found = {}
    for r in got.orderBy("doc", "position").collect():
        found.setdefault(r["doc"], []).append(tuple(r["number"]) if r["number"] else None)
    assert found == {doc: wanted for doc, (_, wanted) in CONTENTS.items()}


def test_back_equals_steps(spark):
    def back(n, k):
        for _ in range(k):
            n = (*n[:-1], n[-1] - 1) if n[-1] > 1 else n[:-1]
            if not n:
                return None
        return n

    cases = [(i, n, k) for i, (n, k) in enumerate((n, k) for n in [(4, 4), (2,), (1, 1, 1), (3, 2, 5)] for k in range(14))]
    df = spark.createDataFrame([(i, list(n), k) for i, n, k in cases], "i int, n array<int>, k int")
    got = {r["i"]: tuple(r["x"]) if r["x"] else None for r in df.select("i", outlines._back(F.col("n"), F.col("k")).alias("x")).collect()}
    assert got == {i: back(n, k) for i, n, k in cases}


def test_markers_first(spark):
    items = [
        ("list_item", "First 1.", "1. First"), ("list_item", "Inner a)", "a) Inner"), ("list_item", "Other b)", "b) Other"), ("list_item", "Second 2.", "2. Second"), ("list_item", "Out of turn 9.", "Out of turn 9."), ("heading", "Third 3.", "3. Third"),
        ("list_item", "Alone c)", "c) Alone"), ("list_item", "Dot •", "• Dot"), ("heading", "Dot •", "Dot •"), ("text", "Text 4.", "Text 4."), ("list_item", "- Has one 4.", "- Has one 4."), ("list_item", None, None),
    ]
    data = [("d", i, k, t, 1) for i, (k, t, _) in enumerate(items)] + [("e", 0, "list_item", "Only 1.", 1), ("e", 1, "list_item", "Again 1.", 1)]
    got = outlines.markers_first(spark.createDataFrame(data, "doc string, position int, kind string, text string, digits int"))
    texts = {(r["doc"], r["position"]): r["text"] for r in got.collect()}
    assert texts == {("d", i): w for i, (_, _, w) in enumerate(items)} | {("e", 0): "Only 1.", ("e", 1): "Again 1."}


def test_question_headings(spark):
    data = [("d", 0, "12 Publik fråga\nHej"), ("d", 1, "Publik  fråga 13"), ("d", 2, "Privat fråga"), ("d", 3, "Publik fråga om pris"), ("e", 0, "1 Publik fråga"), ("e", 1, None)]
    got = outlines.question_headings(spark.createDataFrame(data, "doc string, position int, text string"))
    assert rows(got) == [("d", 0, "12", "Publik fråga", 1), ("d", 1, "13", "Publik fråga", 1), ("d", 2, None, "Privat fråga", 1)]


def test_split_upload(spark):
    text = "one line\n" + "a" * 30 + "\n" + "b" * 30 + "\nlast words"
    sections = spark.createDataFrame([("f", 0, "T", text, 1, 3, "6"), ("f", 1, "U", "short", 3, None, None), ("f", 2, "V", None, 3, 3, None), ("g", 0, "W", "x" * 95, None, None, None)], "file string, position int, title string, text string, page_start int, page_end int, number string")
    lines = spark.createDataFrame([("f", 2, "a" * 30), ("f", 1, "b" * 30), ("f", 3, " " + "b" * 30), ("f", 9, "last words")], "file string, page int, text string")
    got = outlines.split_upload(sections, lines, 40).orderBy("file", "position", "piece").collect()
    assert [(r["file"], r["title"], r["text"], r["page"], r["number"]) for r in got] == [
        ("f", "T (del 1 av 3)", "one line\n" + "a" * 30, 1, "6"), ("f", "T (del 2 av 3)", "b" * 30, 1, "6"), ("f", "T (del 3 av 3)", "last words", 1, "6"), ("f", "U", "short", 3, None),
        ("g", "W (del 1 av 3)", "x" * 40, None, None), ("g", "W (del 2 av 3)", "x" * 40, None, None), ("g", "W (del 3 av 3)", "x" * 15, None, None),
    ]


def test_pieces_of_a_text():
    assert outlines.cut_late("aaaa bbbb\n\ncccc dddd", 14) == ["aaaa bbbb", "cccc dddd"]
    assert outlines.cut_late("aaaa bbbb cccc", 10) == ["aaaa bbbb", "cccc"]
    assert outlines.cut_late("  ", 5) == [] and outlines.cut_late("a" * 7, 3) == ["aaa", "aaa", "a"]


def test_heading_similarity(spark):
    pairs = [("Skäl för", "Skäl för uteslutning"), ("Ramavtal", "Ramavtalets handlingar"), ("försäljningsredovisning och administrativ avgift) de", "Försäljningsredovisning och administrationsavgift"), ("", "x"), ("Pris", "pris!")]
    got = {(r["phrase"], r["title"]): r["similarity"] for r in outlines.heading_similarity(spark.createDataFrame(pairs, "phrase string, title string")).collect()}
    assert got["Skäl för", "Skäl för uteslutning"] == 1 and got["", "x"] == 0 and got["Pris", "pris!"] == 1
    assert got["Ramavtal", "Ramavtalets handlingar"] == SequenceMatcher(None, "ramavtalets", "ramavtal").ratio()


def test_close_texts_equal_all_pairs(spark):
    rng = random.Random(3)
    some = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
    asked, known = sorted({some() for _ in range(80)}), sorted({some() for _ in range(80)})
    got = outlines.close_texts(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(k,) for k in known], "known string"))
    wanted = {(a, k) for a in asked for k in known if SequenceMatcher(None, k, a).ratio() >= 0.75}
    assert {(r["asked"], r["known"]) for r in got.collect()} == wanted and len(wanted) > 50


def test_guess_areas(spark):
    areas = ["IT-drift", "E-litteratur", "Programvaror och tjänster", "Bemanningstjänster", "IT-konsulttjänster", "Möbler"]
    df = spark.createDataFrame([(a,) for a in areas], "area string")
    asked = ["it", "IT-drift Större", "bemanningstjanster", "programvara", "möbler", "xyz", "", None, "tjänster"]
    found: dict = {}
    for r in outlines.guess_areas(spark.createDataFrame([(a,) for a in asked], "asked string"), df).orderBy("asked", "rank").collect():
        found.setdefault(r["asked"], []).append(r["area"])
    assert found == {
        "it": ["IT-drift", "IT-konsulttjänster", "E-litteratur"],
        "IT-drift Större": ["IT-drift"],
        "bemanningstjanster": ["Bemanningstjänster"],
        "programvara": ["Programvaror och tjänster"],
        "tjänster": ["Programvaror och tjänster", "Bemanningstjänster", "IT-konsulttjänster"],
    }
