"""Hard negatives by ball trees with bounds on both sides.

Vectors are dealt into groups of bounded size, each under the nearest of a few
centres, and every group is made into a ball tree when it is searched. For an
anchor a and a ball with centre c and radius r, all inner products lie between
a.c - |a| r and a.c + |a| r. An anchor's positives are the best of its own label.
For each of them the negatives have to lie in a window of scores that hangs on
the positive's: balls whose bounds lie wholly above or below the window are left
out, and so are balls whose upper bound is strictly beneath the k-th score found
so far. What is left is scored exactly, in the order of the upper bounds.

Groups go to blocks of anchors only where the root ball of the group can reach a
window of some anchor in the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.llm.common import table, written

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A negative's score is at least this many hundredths of the positive's, and at most all of it.
LEAST, MOST = 80, 100
#: Rows of a leaf; rows of a group, fewer where vectors are long, so that a group has so many components at most; anchors of a block.
LEAF, GROUP, COMPONENTS, BLOCK = 64, 8192, 2**21, 1024
CENTRES, SAMPLE = 16, 1000
#: Candidates scored at a time.
CHUNK = 1024
#: Components are held within these bounds, and scores within those of 64 bits.
LARGEST, HIGHEST = 2**53, 2**63 - 1
#: Share by which bounds in double precision are widened.
SLACK = 1e-9


@dataclass
class Tree:
    """A balanced ball tree: node i has the children 2i+1 and 2i+2, and the leaves stand for equal shares of the rows, in order."""

    v: np.ndarray  # vectors, in the order of the leaves
    ids: np.ndarray
    labels: np.ndarray
    cuts: np.ndarray  # where the leaves begin, and the end
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray  # smallest and largest label of a node
    high: np.ndarray


def grow(v: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Tree:
    """Each ball is cut at the median along the line between two of its far points."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(v)) / LEAF))))
    order = np.lexsort((ids,))
    x = v[order].astype(float)
    spans = [(0, len(v))]
    for _ in range(depth):
        below = []
        for a, b in spans:
            part = x[a:b]
            far = part[np.linalg.norm(part - part.mean(0), axis=1).argmax()] if b > a else None
            middle = (a + b) // 2
            if b - a > 1:
                other = part[np.linalg.norm(part - far, axis=1).argmax()]
                along = np.argsort(part @ (other - far), kind="stable")
                order[a:b], x[a:b] = order[a:b][along], part[along]
            below += [(a, middle), (middle, b)]
        spans = below
    n = 2 ** (depth + 1) - 1
    centre, radius, low, high = np.zeros((n, v.shape[1])), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = 2**depth - 1
    whole = dict(enumerate(spans, first))
    for i in range(n - 1, -1, -1):
        if i < first:
            whole[i] = whole[2 * i + 1][0], whole[2 * i + 2][1]
        a, b = whole[i]
        if b > a:
            centre[i] = x[a:b].mean(0)
            radius[i] = np.linalg.norm(x[a:b] - centre[i], axis=1).max()
            low[i], high[i] = labels[order[a:b]].min(), labels[order[a:b]].max()
    return Tree(v[order], ids[order], labels[order], np.array([a for a, _ in spans] + [len(v)]), centre, radius, low, high)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats where they hold them, else in whole numbers held within 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < 2.0**50:
        kind = np.float32 if most < 2.0**24 else np.float64
        return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)
    held = lambda n: max(-HIGHEST, min(HIGHEST, n))
    return np.array([[held(sum(a * b for a, b in zip(r, c, strict=True))) for c in x.tolist()] for r in q.tolist()], np.int64).reshape(len(q), len(x))


@dataclass
class Asked:
    """Questions of a block of anchors: each names its anchor, as a row number, and a window of scores."""

    v: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray
    least: np.ndarray
    most: np.ndarray


def search(tree: Tree, asked: Asked, alike: bool, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(questions, ids, scores): each question's best in the tree within its window, among rows of the anchor's label (alike) or of the others."""
    if not len(tree.v) or not len(asked.anchor):
        return
    q, of = asked.v.astype(float), asked.anchor
    length, label = np.linalg.norm(q, axis=1), asked.labels
    least, most = asked.least.astype(float), asked.most.astype(float)

    def bounds(nodes: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds, and which nodes each question still has to visit."""
        middle, reach = q @ tree.centre[nodes].T, length[:, None] * tree.radius[nodes]
        slack = SLACK * (np.abs(middle) + reach + length[:, None] * np.linalg.norm(tree.centre[nodes], axis=1) + 1)
        upper, lower = (middle + reach + slack)[of], (middle - reach - slack)[of]
        low, high, own = tree.low[nodes][None], tree.high[nodes][None], label[of][:, None]
        fits = (low <= own) & (own <= high) if alike else (low != own) | (high != own)
        return upper, live & fits & (upper >= least[:, None]) & (lower <= most[:, None])

    nodes, live = np.array([0]), np.ones((len(of), 1), bool)
    upper, live = bounds(nodes, live)
    while nodes[0] < len(tree.radius) // 2:
        nodes, live = np.stack([2 * nodes + 1, 2 * nodes + 2], 1).ravel(), np.repeat(live, 2, axis=1)
        some = live.any(0)
        upper, seen = np.full(live.shape, -np.inf), np.zeros_like(live)
        if some.any():
            upper[:, some], seen[:, some] = bounds(nodes[some], live[:, some])
        live = seen
    upper[~live] = -np.inf
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(of)
    worst = asked.least.copy()
    leaves = np.argsort(-upper.max(0), kind="stable")
    each = max(1, CHUNK // LEAF)
    for k in range(0, len(leaves), each):
        some = leaves[k : k + each]
        bound = upper[:, some].max(1)
        open_ = np.flatnonzero((bound > -np.inf) & (bound >= worst.astype(float)))
        if not len(open_):
            if upper[:, some].max() == -np.inf:
                break
            continue
        rows = np.concatenate([np.arange(tree.cuts[i], tree.cuts[i + 1]) for i in some])
        anchors, at = np.unique(of[open_], return_inverse=True)
        score = _products(asked.v[anchors], tree.v[rows])
        same = tree.labels[rows][None] == label[anchors][:, None]
        usable = (same if alike else ~same) & (tree.ids[rows][None] != asked.ids[anchors][:, None])
        for j, n in zip(open_, at, strict=True):
            hit = np.flatnonzero(usable[n] & (score[n] >= worst[j]) & (score[n] <= asked.most[j]))
            if len(hit):
                ids, scores = np.append(best[j][0], tree.ids[rows[hit]]), np.append(best[j][1], score[n][hit])
                keep = np.lexsort((ids, -scores))[:top]
                best[j] = ids[keep], scores[keep]
                if len(keep) == top:
                    worst[j] = max(worst[j], scores[keep[-1]])
    for j, (ids, scores) in enumerate(best):
        yield np.full(len(ids), j), ids, scores


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dim, v): floor(scale * x) of each component, as bytes; rows with a null id, label or vector, or a component that is null or not finite, are left out."""
    held = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), scale * x.cast("double")))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    ints = usable.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(held(x)).cast("long")).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(b.column("dim").to_numpy())
            parts = [flat[a:e].tobytes() for a, e in zip(np.append(0, ends[:-1]), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("dim"), pa.array(parts, pa.binary())], ["vec_id", "label", "dim", "v"])

    return ints.distinct().mapInArrow(pack, "vec_id long, label long, dim int, v binary")


def _vectors(t: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("v").to_pylist()), "<i8").reshape(t.num_rows, dim)


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension up to CENTRES vectors of a sample (those of the smallest hashes), each farthest from those before."""
    found = {}
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow()
    for dim in sorted(set(sample.column("dim").to_pylist())):
        x = _vectors(sample.filter(pa.compute.equal(sample.column("dim"), dim)), dim).astype(float)
        picked, far = [0], np.full(len(x), np.inf)
        while len(picked) < min(CENTRES, len(x)):
            far = np.minimum(far, np.linalg.norm(x - x[picked[-1]], axis=1))
            if far.max() == 0:
                break
            picked.append(int(far.argmax()))
        found[dim] = x[picked]
    return found


def near_centre(vectors: DataFrame, found: dict[int, np.ndarray]) -> DataFrame:
    """vectors with near, the number of the nearest centre."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for dim in sorted(set(t.column("dim").to_pylist())):
                own = t.filter(pa.compute.equal(t.column("dim"), dim))
                x, c = _vectors(own, dim).astype(float), found.get(dim, np.zeros((1, dim)))
                near = ((c**2).sum(1)[None] - 2 * (x @ c.T)).argmin(1)
                yield from own.append_column("near", pa.array(near, pa.int32())).to_batches()

    return vectors.mapInArrow(work, "vec_id long, label long, dim int, v binary, near int")


def _dealt(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """vectors with part: groups of equal keys are cut into parts of bounded size, by a hash of the row."""
    most = F.greatest(F.lit(LEAF), F.least(F.lit(GROUP), (F.lit(COMPONENTS) / F.greatest("dim", F.lit(1))).cast("int")))
    sizes = vectors.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / most).cast("int")).drop("rows")
    return vectors.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")).drop("parts")


def _roots(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the centre and radius of a ball around each group, and its labels."""

    def work(t: pa.Table) -> pa.Table:
        x = _vectors(t, t.column("dim")[0].as_py()).astype(float)
        middle = x.mean(0)
        labels = t.column("label").to_numpy()
        return pa.table([*[t.column(k)[:1] for k in keys], pa.array([middle.tolist()], pa.list_(pa.float64())), [float(np.linalg.norm(x - middle, axis=1).max(initial=0))], [int(labels.min())], [int(labels.max())]], [*keys, "centre", "radius", "low", "high"])

    return grouped.groupBy(*keys).applyInArrow(work, ", ".join(f"{k} {dict(grouped.dtypes)[k]}" for k in keys) + ", centre array<double>, radius double, low long, high long")


def _found(grouped: DataFrame, asked: DataFrame, keys: list[str], visits: DataFrame, alike: bool, top: int) -> DataFrame:
    """(anchor_id, positive_id, vec_id, score): search() of every visited group by the questions of a block.

    visits (keys, block) says which groups meet which blocks; asked has (block,
    dim, vec_id, label, v, windows), one row per anchor.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            tree = grow(_vectors(left, dim), left.column("vec_id").to_numpy(), left.column("label").to_numpy())
            windows = right.column("windows").to_pylist()
            anchor = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            each = [w for some in windows for w in some]
            column = lambda name: np.array([w[name] for w in each], np.int64)
            ids = right.column("vec_id").to_numpy()
            questions = Asked(_vectors(right, dim), ids, right.column("label").to_numpy(), anchor, column("least"), column("most"))
            if parts := list(search(tree, questions, alike, top)):
                j, vec, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
                out = [ids[anchor[j]], column("positive_id")[j], vec, score]
        return pa.table([pa.array(c.astype(np.int64)) for c in out], ["anchor_id", "positive_id", "vec_id", "score"])

    met = [*keys, "block"]
    shipped = grouped.join(visits, keys).select(*met, *[c for c in ("dim", "vec_id", "label", "v") if c not in met])
    questions = asked.join(visits, [c for c in met if c in asked.columns]).select(*met, *[c for c in ("dim", "vec_id", "label", "v", "windows") if c not in met])
    left, right = shipped.toDF(*shipped.columns), questions.toDF(*questions.columns)
    return left.groupBy(*met).cogroup(right.groupBy(*met)).applyInArrow(work, "anchor_id long, positive_id long, vec_id long, score long")


def _best(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= top)


def _window(score: Column) -> Column:
    """The struct of a positive's window; bounds as whole numbers, in decimals as five times a score may be beyond 64 bits."""
    wide = score.cast("decimal(38,0)")
    return F.struct(F.col("vec_id").alias("positive_id"), F.ceil(LEAST * wide / F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("least"), score.alias("most"))


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by `every`. A positive is one
    of the first `positives` other rows of the anchor's label and length, by score
    and then by smaller vec_id; its negatives are the first rows of other labels
    and the same length whose score is between LEAST hundredths of the positive's
    and the positive's. Rows with a null id, label or vector, or a component that
    is null or not finite, take no part. Equal rows count once; rows of one vec_id
    that differ are searched each, but are no positives of each other. Empty
    tables give no rows, and so do anchors without positives or negatives.
    Components beyond 2**53 are held there, and scores at the ends of 64 bits.
    """
    vectors = integer_vectors(embeddings)
    vectors = written(near_centre(vectors, centres(vectors)), "vectors")
    anchors = vectors.filter(F.col("vec_id") % every == 0).drop("near")
    blocks = max(1, -(-anchors.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")

    # Positives: groups are of one label, and an anchor visits those of its own.
    alike = _dealt(vectors.drop("near"), ["dim", "label"])
    open_ = F.array(F.struct(F.col("vec_id").alias("positive_id"), F.lit(-HIGHEST - 1).alias("least"), F.lit(HIGHEST).alias("most")))
    asked = anchors.withColumns({"block": block, "windows": open_})
    own = alike.select("dim", "label", "part").distinct().join(asked.select("dim", "label", "block").distinct(), ["dim", "label"])
    good = _best(_found(alike, asked, ["dim", "label", "part"], own, True, positives).drop("positive_id"), ["anchor_id"], positives)
    good = written(good.select("anchor_id", "vec_id", "score"), "positives")

    # Negatives: an anchor's windows, and the groups whose root ball reaches one of them.
    windows = good.groupBy("anchor_id").agg(F.collect_list(_window(F.col("score"))).alias("windows"))  # as many as there are positives
    asked = written(anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id").withColumn("block", block), "anchors")
    keys = ["dim", "near", "part"]
    mixed = _dealt(vectors, ["dim", "near"])
    visits = written(_reached(_roots(mixed, keys), asked, keys, blocks), "visits")
    found = _best(_found(mixed, asked, keys, visits, False, negatives), ["anchor_id", "positive_id"], negatives)
    scores = good.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _reached(roots: DataFrame, asked: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """(keys, block): the groups in which some anchor of the block may find a negative."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    wide = {"anchor": F.col("a"), "least": F.array_min(F.transform("windows", lambda w: w["least"].cast("double"))), "most": F.array_max(F.transform("windows", lambda w: w["most"].cast("double")))}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.frombuffer(x, "<i8").astype(float) for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("dim", "block", "label", "windows")], pa.array([x.tolist() for x in v], pa.list_(pa.float64()))], ["dim", "block", "label", "windows", "a"])

    kind = dict(asked.dtypes)["windows"]
    flat = asked.select("dim", "block", "label", "windows", "v").mapInArrow(unpack, f"dim int, block int, label long, windows {kind}, a array<double>").withColumns(wide)
    each = roots.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = flat.select("dim", "block", "label", "anchor", "least", "most").join(each, ["dim", "block"])
    middle, reach = dot(F.col("anchor"), F.col("centre")), F.sqrt(dot(F.col("anchor"), F.col("anchor"))) * F.col("radius")
    slack = SLACK * (F.abs(middle) + reach + 1)
    fits = (middle + reach + slack >= F.col("least")) & (middle - reach - slack <= F.col("most")) & ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))
    return met.filter(fits).select(*keys, "block").distinct()


def op11_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
