"""Exact top-k by inner product, with pivot tables (LAESA-style elimination).

Distances from every vector to a table of pivots are computed once. By the
triangle inequality the largest difference between two vectors' distances to a
pivot is a lower bound of their own distance, and so gives an upper bound of
their inner product. Candidates are grouped by nearest pivot into groups of
bounded size. A query first searches one group near it, which gives a score that
its k-th result can't be below; it then visits only the groups, and evaluates
only the candidates, whose bound reaches that score, in the order of their
bounds, until the next bound is below the k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.llm.common import table, written

TOP, SCALE, EVERY = 20, 64, 20
PIVOTS = 16
#: Pivots are chosen, each farthest from those before, among so many vectors: those of the smallest hashes.
SAMPLE = 1000
GROUP, QUERIES = 8192, 2048
#: Candidates evaluated at a time.
CHUNK = 1024
#: Rounding of distances between vectors of integers that double precision still holds exactly.
SLACK = 1e-6
#: Components are held within these bounds, and scores within those of 64 bits.
LARGEST, HIGHEST = 2**53, 2**63 - 1
#: Beyond this, squared lengths are no longer exact in double precision.
EXACT = 2.0**50


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, dim): floor(64 * x) of each component; rows with a null id or vector, or a component that is null or not finite, are left out."""
    held = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), SCALE * x.cast("double")))
    ints = F.transform("embedding", lambda x: F.floor(held(x)))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    return usable.select(F.col("vec_id").cast("long"), ints.alias("v"), F.size("embedding").alias("dim"))


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension, up to PIVOTS vectors of the sample, by farthest-first traversal."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    found = {}
    for dim in sorted({r["dim"] for r in sample}):
        x = np.array([r["v"] for r in sample if r["dim"] == dim], float).reshape(-1, dim)
        picked, far = [0], np.full(len(x), np.inf)
        while len(picked) < min(PIVOTS, len(x)):
            far = np.minimum(far, np.linalg.norm(x - x[picked[-1]], axis=1))
            if far.max() == 0:
                break
            picked.append(int(far.argmax()))
        found[dim] = x[picked]
    return found


def with_distances(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, dim, v, n2, d, near): v as bytes, its squared length, its distances to the pivots, and the nearest pivot's number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, rows = (b.column(c).to_pylist() for c in ("vec_id", "dim", "v"))
            for dim in sorted(set(dims)):
                own = [i for i, n in enumerate(dims) if n == dim]
                v = np.array([rows[i] for i in own], "<i8").reshape(len(own), dim)
                x, p = v.astype(float), pivots.get(dim, np.zeros((1, dim)))
                d = np.stack([np.linalg.norm(x - q, axis=1) for q in p], 1)
                columns = [pa.array([ids[i] for i in own], pa.int64()), pa.array([dim] * len(own), pa.int32()), pa.array([r.tobytes() for r in v], pa.binary()), pa.array((x**2).sum(1)), pa.array(list(d), pa.list_(pa.float64())), pa.array(d.argmin(1), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "v", "n2", "d", "near"])

    return vectors.mapInArrow(work, "vec_id long, dim int, v binary, n2 double, d array<double>, near int")


def _products(q: np.ndarray, x: np.ndarray):
    """A function of (queries, candidates), as row numbers, giving exact inner products; in floats that hold them exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < EXACT:
        kind = np.float32 if most < 2.0**24 else np.float64
        qf, xf = q.astype(kind), x.astype(kind)
        return lambda i, j: (qf[i] @ xf[j].T).astype(np.int64)
    held = lambda n: max(-HIGHEST, min(HIGHEST, n))
    return lambda i, j: np.array([[held(sum(a * b for a, b in zip(r, c, strict=True))) for c in x[j].tolist()] for r in q[i].tolist()], np.int64).reshape(len(i), len(j))


def search(q: np.ndarray, q_id: np.ndarray, q_d: np.ndarray, least: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_d: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vec ids, scores) of the queries' best candidates here; least: scores below it aren't wanted.

    Queries go in batches. Candidates are taken in the order of the best bound
    that any query of the batch gives them, a chunk at a time, and evaluated for
    the queries that some bound in the chunk still allows; the batch ends with
    the first chunk whose bounds are all below every query's k-th score.
    """
    if not len(x) or not len(q):
        return
    products = _products(q, x)
    q2, x2 = (q.astype(float) ** 2).sum(1), (x.astype(float) ** 2).sum(1)
    q_d, x_d = q_d.astype(np.float32), np.ascontiguousarray(x_d.T.astype(np.float32))
    for at in range(0, len(q), 128):
        rows = np.arange(at, min(at + 128, len(q)))
        bound = np.zeros((len(rows), len(x)), np.float32)
        for j in range(len(x_d)):
            np.maximum(bound, np.abs(q_d[rows, j, None] - x_d[j][None, :]), out=bound)
        near = np.maximum(bound.astype(float) * (1 - SLACK) - SLACK * (1 + np.sqrt(max(q2[rows].max(), x2.max()))), 0)
        upper = (q2[rows, None] + x2[None, :] - near**2) / 2 * (1 + 1e-12) + SLACK
        worst = least[rows].astype(float)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(rows)
        reach = upper.max(0)
        order = np.argsort(-reach, kind="stable")
        for k in range(0, len(order), CHUNK):
            some = order[k : k + CHUNK]
            if reach[some[0]] < worst.min():
                break  # no later candidate can reach, nor tie with, the last of any query's best
            live = np.flatnonzero(upper[:, some].max(1) >= worst)
            if not len(live):
                continue
            score = products(rows[live], some)
            hit = (score >= worst[live, None]) & (x_id[some][None, :] != q_id[rows[live], None])
            for i, found in zip(live, hit, strict=True):
                if found.any():
                    n = rows[i] - at
                    ids = np.concatenate([best[n][0], x_id[some[found]]])
                    scores = np.concatenate([best[n][1], score[np.searchsorted(live, i)][found]])
                    keep = np.lexsort((ids, -scores))[:top]
                    best[n] = ids[keep], scores[keep]
                    if len(keep) == top:
                        worst[n] = max(worst[n], float(scores[keep[-1]]))
        for n, (ids, scores) in enumerate(best):
            yield np.full(len(ids), q_id[rows[n]]), ids, scores


def _joint(keyed: DataFrame, queries: DataFrame, keys: list[str], top: int) -> DataFrame:
    """search() for every group of candidates and the queries with equal keys."""

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), "<i8").reshape(t.num_rows, -1)
        return v, t.column("vec_id").to_numpy(), np.array(t.column("d").to_pylist(), float)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            parts = list(search(*arrays(right), right.column("least").to_numpy(), *arrays(left), top))
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3)]
        return pa.table([pa.array(c.astype(np.int64), pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return keyed.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(work, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the best `top` by inner product for each row whose vec_id is divisible by `every`.

    Candidates are all usable rows of the same length with another vec_id; ties
    go to the smaller vec_id. Repeated rows of one vec_id are candidates, and
    queries, only once each if their vectors are equal. Empty tables give no rows.
    Finite components whose integers are beyond 2**53 are held there, and scores
    beyond 64 bits at the largest, with ties as above.
    """
    vectors = integer_vectors(embeddings).distinct()
    table_ = written(with_distances(vectors, choose_pivots(vectors)), "vectors")
    # Groups of one nearest pivot, cut to a bounded size.
    sizes = table_.groupBy("dim", "near").agg(F.count("*").alias("n"))
    parts = {(r["dim"], r["near"]): max(1, -(-r["n"] // GROUP)) for r in sizes.collect()}  # as many as there are pivots
    if not parts:
        return table_.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("near").cast("long").alias("score"))
    cut = F.lit(1)
    for (dim, near), n in parts.items():
        if n > 1:
            cut = F.when((F.col("dim") == dim) & (F.col("near") == near), n).otherwise(cut)
    grouped = table_.withColumn("part", F.pmod(F.xxhash64("vec_id"), cut).cast("int"))
    queries = grouped.filter(F.col("vec_id") % every == 0).toDF(*grouped.columns)

    first = _joint(grouped, queries.withColumn("least", F.lit(float("-inf"))), ["dim", "near", "part"], top)
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= top, F.min("score").cast("double")).otherwise(float("-inf")).alias("least"))
    known = queries.drop("part", "near").join(least.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    # What each group can reach at most, by the range of its distances to each pivot; one row per group.
    spans = grouped.select("dim", "near", "part", "n2", F.posexplode("d").alias("pivot", "x")).groupBy("dim", "near", "part", "pivot").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("n2").alias("n2"))
    groups = spans.groupBy("dim", "near", "part").agg(F.array_sort(F.collect_list(F.struct("pivot", "lo", "hi"))).alias("spans"), F.max("n2").alias("most"))
    gap = F.aggregate(F.arrays_zip(F.col("spans"), F.col("d").alias("q")), F.lit(0.0), lambda a, x: F.greatest(a, x["spans"]["lo"] - x["q"], x["q"] - x["spans"]["hi"]))
    gap = F.greatest(gap - SLACK * (1 + gap), F.lit(0.0))
    reach = (F.col("n2") + F.col("most") - gap * gap) / 2 * (1 + 1e-12) + SLACK
    # Blocks of queries, so that the ranges of the groups are compared with the queries in many tasks.
    blocks = max(1, -(-queries.count() // QUERIES))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    known = known.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    keys = ["dim", "near", "part", "block"]
    pairs = known.select("dim", "block", "vec_id", "n2", "d", "least").join(groups.withColumn("block", each), ["dim", "block"]).filter(reach >= F.col("least"))
    pairs = written(pairs.select(*keys, "vec_id"), "visits")
    # Vectors go to the groups and blocks that are visited only.
    visits = pairs.join(known.select("vec_id", "dim", "v", "d", "least"), ["vec_id", "dim"]).select(*keys, "vec_id", "v", "d", "least")
    visits = visits.toDF(*visits.columns)
    shipped = grouped.join(pairs.select(*keys).distinct(), keys[:3]).select("vec_id", "v", "d", *keys)
    shipped = shipped.toDF(*shipped.columns)
    found = _joint(shipped, visits, keys, top)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
