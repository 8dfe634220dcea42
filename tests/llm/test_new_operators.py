"""Hard negatives, content-sort dedup and filter interactions: edge cases, hot groups and brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spandrel.llm import contentsort, hardnegatives, interaction
from tests.conftest import rows

LONG = " ".join(f"word{i}" for i in range(30_000))
SPACE = re.compile(r"[\x20\x09-\x0D]")


# Hard negatives


def negatives(vectors: list[tuple], every: int) -> list[tuple]:
    usable = [(i, n, [math.floor(256 * x) for x in v]) for i, n, v in dict.fromkeys(vectors) if i is not None and n is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in usable:
        if a % every:
            continue
        met = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, n == label) for i, n, w in usable if i != a and len(w) == len(v))
        for s, p, _ in [m for m in met if m[2]][:5]:
            fit = [(-t, i) for t, i, alike in met if not alike and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k, i, -s, t) for k, (t, i) in enumerate(fit, 1)]
    return sorted(out, key=repr)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, label int, embedding array<double>, score string"


def random_vectors(n: int, dim: int, spread: float, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, rng.choice([1, 1, 1, 2, 3]), tuple(m + rng.gauss(0, spread) for m in rng.choice(middles))) for i in range(n)]


@pytest.mark.parametrize(("group", "leaf", "block"), [(8192, 64, 1024), (40, 8, 3), (1, 1, 1)])
def test_negatives_equal_brute_force(spark, monkeypatch, group, leaf, block):
    """Whatever the sizes of groups, leaves and blocks are, and with ties: vectors are repeated under other ids."""
    monkeypatch.setattr(hardnegatives, "GROUP", group)
    monkeypatch.setattr(hardnegatives, "LEAF", leaf)
    monkeypatch.setattr(hardnegatives, "BLOCK", block)
    vectors = random_vectors(90, 5, 0.3)
    vectors += [(i + 1000, n, v) for i, n, v in vectors[:30]]
    df = spark.createDataFrame([(*v, "x") for v in vectors], SCHEMA)
    assert rows(hardnegatives.mine(df, every=10), *COLUMNS) == negatives(vectors, 10)


def test_negatives_of_odd_rows(spark):
    """Nulls, numbers that aren't finite, other lengths and repeated rows take no part or count once; no rows give none."""
    v = (0.5, 0.25)
    odd = [(0, 1, v), (0, 1, v), (1, 1, v), (2, 2, v), (None, 1, v), (3, None, v), (4, 2, None), (5, 2, (0.5, None)), (6, 2, (math.nan, 1.0)), (7, 2, (math.inf, 1.0)), (8, 2, (0.5,)), (9, 1, ()), (10, 2, ())]
    df = spark.createDataFrame([(*x, "x") for x in odd], SCHEMA)
    assert rows(hardnegatives.mine(df, every=10), *COLUMNS) == [(0, 1, 1, 2, 128 * 128 + 64 * 64, 128 * 128 + 64 * 64)]
    assert hardnegatives.mine(df.filter("false")).count() == 0


def test_trees_bound_all_products():
    rng = np.random.default_rng(3)
    v = rng.integers(-99, 99, (500, 6))
    tree = hardnegatives.grow(v, np.arange(500), rng.integers(0, 3, 500))
    assert sorted(tree.ids.tolist()) == list(range(500))
    spans = list(zip(tree.cuts[:-1], tree.cuts[1:], strict=True))
    a, first = rng.normal(size=6), len(tree.radius) - len(spans)
    for i, (b, e) in enumerate(spans, first):
        middle, reach = a @ tree.centre[i], np.linalg.norm(a) * tree.radius[i]
        products = tree.v[b:e] @ a
        assert (products <= middle + reach + 1e-9).all() and (products >= middle - reach - 1e-9).all()


def test_search_prunes_what_windows_leave_out(monkeypatch):
    """Far from all candidates nothing is scored; a window that only some balls reach has only those scored."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(90, 110, (300, 3)), rng.integers(-110, -90, (300, 3))])
    tree = hardnegatives.grow(v, np.arange(600), np.ones(600, np.int64))
    scored = []
    monkeypatch.setattr(hardnegatives, "CHUNK", hardnegatives.LEAF)
    monkeypatch.setattr(hardnegatives, "_products", lambda q, x, f=hardnegatives._products: scored.append(len(x)) or f(q, x))

    def found(least, most):
        scored.clear()
        asked = hardnegatives.Asked(np.array([[1, 1, 1]]), np.array([-1]), np.array([2]), np.array([0]), np.array([least]), np.array([most]))
        return [x for _, ids, _ in hardnegatives.search(tree, asked, False, 5) for x in ids]

    assert found(1000, 2000) == [] and not scored
    assert all(i < 300 for i in found(200, 400)) and 0 < sum(scored) < 300


# Content sort

DOCS = [(1, "a b\tc"), (2, "abc"), (3, " a  b  c "), (4, None), (5, ""), (6, " \n"), (7, LONG), (8, LONG), (None, "abc"), (9, "ABC"), (9, "ABC"), (10, "a b")]


def copies(docs: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for i, t in docs:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for norm, found in groups.items():
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, found[0][2], len(found), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, (_, _, i) in enumerate(found)]
    return sorted(out, key=repr)


GROUPS = ("row", "keep_row", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_content_sort(spark, partitions):
    """A group that fills several partitions is one group, as are those at their edges."""
    rng = random.Random(5)
    docs = DOCS + [(100 + i, "the same text " + " " * rng.randrange(9)) for i in range(400)] + [(1000 + i, "x" * rng.randrange(70, 90)) for i in range(200)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "row long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(contentsort.groups(df), *GROUPS) == copies(docs)
        kept = contentsort.groups(df.filter("text LIKE 'the same%'")).filter("kept").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kept == 1


def test_content_sort_of_nothing_and_whole_rows(spark):
    df = spark.createDataFrame([(i, t, "s", 1, {"m": 1}) for i, t in DOCS], "doc_id long, text string, kept string, row int, part map<string,int>")
    assert contentsort.groups(df.select(F.col("doc_id").alias("row"), "text").filter("false")).count() == 0
    left = contentsort.deduplicated(df)
    assert left.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _, _, kept, _ in copies(DOCS) if kept)


# Filter interactions


def audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first: dict = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[s or ""].append((i, {k for k, f in fails.items() if f}))
    out = []
    for part, found in parts.items():
        share: Counter = Counter()
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = found
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                share[f] += len(gone)
                earlier = sum(f in d[1] for d in found) - len(gone)
                lines.append((part, order, step, len(left), len(gone), earlier, sum(d[1] == {f} for d in found), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(*x, share[x[1][x[2] - 1]]) for x in lines]
    return sorted(out, key=repr)


PARTS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_interactions_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "a", LONG, "A B C D", "#", " ".join(["x"] * 60), " ".join(f"w{i}" for i in range(50)), " ".join(f"W{i}" for i in range(60)) + " $"]
    docs = [(i, rng.choice(texts), rng.choice(["s", "s", "t", "", None])) for i in range(150)] + [(3, "a", "t"), (3, "a", "t"), (None, "a", "s"), (None, "b", "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*x, "m", 1) for x in docs], "doc_id long, text string, source string, mask string, n int")
    got = rows(interaction.interactions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), *PARTS)
    assert got == audit(docs, labels)
    assert len(got) == 600 * 4


def test_filter_interactions_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.interactions(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    got = interaction.interactions(one, labels).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and {r["shapley"] for r in got if r["filter_order"][r["step"] - 1] == "A"} == {120}
