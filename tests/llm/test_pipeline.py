"""The pipeline's stages one by one, against brute force."""

import corpus_pipeline as pipeline
from spandrel.llm.common import table
from tests.conftest import SMALL, rows
from tests.llm import brute


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).persist()
        assert docs.columns == columns, name
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert set(after) == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
        if name == "near_dedup":
            assert set(after) == {c for _, c in brute.near(list(before.items())).values()}
        if name == "pii":
            assert set(after) == set(before)
            assert all(t == before[i] for i, t in after.items() if not brute.private(before[i]) and "<" not in t)
            assert all(not brute.private(t) for t in after.values())
        before = after
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(before)


def test_run(spark):
    assert rows(pipeline.run(spark, SMALL).select("doc_id").distinct())
