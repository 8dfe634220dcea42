"""Lists and outlines are read in sorted batches, not a group at a time."""

import pytest

from spandrel.operators import outlines, validation
from tests.conftest import rows


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    yield
    spark.conf.set(name, before)


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_marker_runs_over_batches(spark, small_batches):
    said = [(d, i, "list_item", t) for d in range(5) for i, t in enumerate(["Led 1.", "Led 1.", "Led 2.", "Led 7.", "Led 3.", "Led a.", "Led 1."])]
    df = outlines.markers_first(spark.createDataFrame(said, "doc long, position long, kind string, text string"))
    wanted = ["Led 1.", "1. Led", "2. Led", "Led 7.", "3. Led", "Led a.", "Led 1."]
    assert rows(df, "doc", "position", "text") == sorted((d, i, t) for d in range(5) for i, t in enumerate(wanted))
    assert "FlatMapGroupsInPandas" not in _plan(df)


def test_chains_over_batches(spark, small_batches):
    found = [(d, i, n, f"T{i}", 1.0, False) for d in range(5) for i, n in enumerate(["1", "1.1", "9.9.9", "2", "2.1"])]
    df = outlines.choose(spark.createDataFrame(found, "doc long, position long, number string, title string, score double, listed boolean"))
    kept = [(0, "1", 1), (1, "1.1", 2), (3, "2", 1), (4, "2.1", 2)]
    assert rows(df, "doc", "position", "number", "title", "level") == sorted((d, i, n, f"T{i}", level) for d in range(5) for i, n, level in kept)
    assert "FlatMapGroupsInPandas" not in _plan(df)


def test_latest_wording_of_a_whole_file(spark):
    """A citation of a whole file, whose amendment is cited."""
    cited = spark.createDataFrame([(1, "a", None), (1, "b", 2), (2, "a", None), (2, "a", 1)], "draft int, sha256 string, section_position int")
    amendments = spark.createDataFrame([("a", None, "b", 2), ("a", 3, "b", 4)] * 50, "target_sha256 string, target_section_position int, sha256 string, section_position int")
    assert rows(validation.latest_wording(cited, amendments)) == sorted([(2, "a", None), (2, "a", 1)], key=repr)


def test_nearest_in_blocks(spark, monkeypatch):
    """Small blocks hold the same best pairs as all pairs; irregular vectors meet everything; no pair is made in the plan."""
    import random

    from spandrel.operators import search

    draw = random.Random(3)
    data = [(i, [round(draw.uniform(-1, 1), 1) for _ in range(6)], i % 3) for i in range(60)] + [(60, None, 0), (61, [1.0], 1), (62, [0.5] * 6, None)]
    c = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    for name, size in (("QUESTIONS", 3), ("CANDIDATES", 7), ("AT_ONCE", 2)):
        monkeypatch.setattr(search, name, size)
    got = search.nearest(c.filter("vec_id % 10 = 0"), c, 3, 4, 2).collect()
    pairs = {(r["question"], r["vec_id"]): r for r in got}
    assert len(pairs) == len(got) and all((q, i) in pairs for q in range(0, 60, 10) for i in (60, 61))
    dot = lambda a, b: round(sum(float(x) * float(y) for x, y in zip(a, b, strict=True)), 5)
    vector = {i: [float(x) for x in v] for i, v, _ in data if v and len(v) == 6}
    label = {i: n for i, _, n in data}
    for q in range(0, 60, 10):
        others = [i for i in vector if i != q]
        near = sorted(others, key=lambda i: (-dot(vector[q][:3], vector[i][:3]), i))[:4]
        own = sorted((i for i in others if label[i] == label[q]), key=lambda i: (-dot(vector[q], vector[i]), i))[:2]
        assert all((q, i) in pairs for i in near + own)
        assert all(abs(pairs[q, i]["coarse"] - dot(vector[q][:3], vector[i][:3])) < 1e-4 for i in near)
