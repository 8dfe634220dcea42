"""Near-duplicate documents by SetSketch registers, confirmed on full shingle sets.

1. One pass over the texts gives each document the size, a 128-bit hash and the
   SetSketch registers of its set of 5-word shingles. Documents with equal sets
   are one class from here on, whatever their number.
2. Registers are cut into bands; classes that agree on a band meet in a bucket.
   In each bucket all members are compared with its smallest member. Pairs are
   estimated jointly by likelihood from the registers, and those that may reach
   the threshold are confirmed on their full sets, made anew from the texts.
3. A bucket whose members are in one component by then is done. In the others,
   all members outside the bucket's largest component are compared with all
   members of other components, in blocks of bounded size, from registers first
   and then on full sets; a pair that agrees on several bands is compared in the
   first one only. So no pair of different texts that meets in a bucket is
   dropped, whatever the bucket's size, and none is listed that can't change a
   component.

All state between steps is in tables; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import forget, small_batches, small_enough, table, written
from spandrel.llm.graphs import components
from spandrel.llm.setsketch import REGISTERS, likely_jaccard, sketch
from spandrel.llm.shingles import mix, shingle_sets

WIDTH, PERCENT = 5, 75
#: Registers in a band: 32 bands miss a pair of similarity 0.75 with probability (1 - 0.75^4)^32 = 5e-6.
ROWS = 4
#: Pairs estimated below this (five standard errors under 0.75) aren't confirmed.
LEAST_ESTIMATE = 0.56
#: Most ids that are broadcast to pick the texts of candidate pairs.
BROADCAST_IDS = 2_000_000
_SIZE = 2 * ROWS
#: Most members, and about the most shingles, in a block of a bucket.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 500_000


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, lo, hi, registers) per row: size, 128-bit hash and registers of the shingle set; a null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = np.uint64(0xD6E8FEB86659FD93)
        for b in (whole.slice(at, 250) for whole in batches for at in range(0, whole.num_rows, 250)):
            n, lo, hi, regs = [], [], [], []
            for s in shingle_sets([x or "" for x in b.column("text").to_pylist()], width):
                n.append(len(s))
                lo.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                hi.append(int(mix(s ^ two).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                regs.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n", "lo", "hi", "registers"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n long, lo long, hi long, registers binary")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, hashes): full shingle sets of the documents whose ids are given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 250) for whole in batches for at in range(0, whole.num_rows, 250)):
            sets = [s.view(np.int64) for s in shingle_sets([x or "" for x in b.column("text").to_pylist()], width)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return picked.mapInArrow(work, "node long, hashes array<long>")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes allow the threshold and whose registers make it likely enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                regs = [np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("regs_a", "regs_b")]
                sizes = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
                yield b.filter(pa.array(likely_jaccard(*regs, *sizes) >= LEAST_ESTIMATE)).select(["a", "b"])

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"regs_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return joined.mapInArrow(work, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) of the pairs whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"set_{x}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * both >= PERCENT * (F.size("set_a") + F.size("set_b") - both)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if their shingle sets have a Jaccard similarity of at
    least 0.75; component_id is the smallest doc_id that can be reached. A text
    without words is linked with nothing. Rows of one doc_id are one document,
    with the links of each of its texts. A null doc_id can't be linked: its
    component_id is null and it is kept. An empty table gives no rows; other
    columns are not read.
    """
    rows = written(sketched(small_batches(docs), width), "sketches")
    grouped = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("lo", "hi").agg(F.min_by(F.struct("doc_id", "n", "registers"), "doc_id").alias("x"))
    classes = written(grouped.select("lo", "hi", F.col("x.doc_id").alias("node"), "x.n", "x.registers"), "classes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * _SIZE + 1, F.lit(_SIZE))))
    bands = classes.select("node", "n", F.posexplode(keys).alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("size")).filter("size > 1").drop("size")
    members = written(bands.join(buckets, "key"), "members")
    sets = written(_sets(docs, members.select("node").distinct(), width), "sets")

    pairs = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    edges = written(_confirmed(_likely(pairs, classes), sets), "edges")
    linked = written(components(edges), "linked")
    more = written(_across(members.drop("centre"), linked, classes, sets), "edges")
    if not more.isEmpty():
        before, linked = linked, written(components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "linked")
        forget(before)
    for done in (members, sets, edges, more):
        forget(done)

    named = classes.join(linked, "node", "left").select("lo", "hi", "node", F.coalesce("component", "node").alias("component"))
    named = named.join(named.groupBy("node").agg(F.min("component").alias("least")), "node").select("lo", "hi", F.least("component", "least").alias("component"))
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    # Texts without words have no class; a key of their own keeps them from meeting in one task.
    keyed = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("lo")).otherwise(F.xxhash64("doc_id")).alias("lo"), F.when(F.col("n") > 0, F.col("hi")).otherwise(F.lit(0)).alias("hi"))
    found = keyed.join(named, ["lo", "hi"], "left").withColumn("component_id", own)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with one row of each group: of the smallest doc_id, and of its rows the first in the order of its columns. Rows with a null doc_id all stay; columns may have any names."""
    found = near_duplicates(docs, width).filter(~F.col("kept")).select("doc_id").distinct()
    found = F.broadcast(found) if small_enough(found, BROADCAST_IDS) else found
    left = docs.join(found, "doc_id", "left_anti").select(docs.columns)
    twice = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    if twice.isEmpty():
        return left
    rows = left.join(twice, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"))
    several = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*")
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(several)


def _across(members: DataFrame, linked: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) that join components, from all pairs across components in every bucket of members (key, band, node, n)."""
    named = members.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = named.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    whole = parts.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("parts"), F.max("rows").alias("in_main"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")).filter("parts > 1")
    blocks = lambda rows: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    whole = whole.select("key", "main", blocks(F.col("rows") - F.col("in_main")).alias("n_few"), blocks(F.col("rows")).alias("n_all"))
    placed = named.join(whole, "key")
    # Every block of members outside the main component meets every block of the bucket.
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("node"), F.col(n)).cast("int"))
    few = placed.filter("component <> main").select("key", "band", "node", "component", F.lit(True).alias("few"), F.explode(own("n_few")).alias("i"), each("n_all").alias("js")).withColumn("j", F.explode("js")).drop("js")
    all_ = placed.select("key", "band", "node", "component", F.lit(False).alias("few"), F.explode(each("n_few")).alias("i"), own("n_all").alias("js")).withColumn("j", F.explode("js")).drop("js")
    outside = placed.filter("component <> main").select("key", "node", F.lit(True).alias("outside"))
    all_ = all_.join(outside, ["key", "node"], "left").withColumn("outside", F.coalesce("outside", F.lit(False)))
    rows = few.withColumn("outside", F.lit(True)).unionByName(all_).join(classes.select("node", "registers"), "node").join(sets, "node")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare, "u long, v long").distinct()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between components within each group of rows with equal (key, i, j), which come together."""
    held: list[dict] = []
    last = None

    def edges() -> pa.RecordBatch:
        found = _edges(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    for b in batches:
        for at in range(0, b.num_rows, 200):
            for row in b.slice(at, 200).to_pylist():
                now = row["key"], row["i"], row["j"]
                if now != last and held:
                    yield edges()
                last = now
                row["hashes"] = np.array(row["hashes"], np.int64)
                held.append(row)
    if held:
        yield edges()


def _edges(rows: list[dict]) -> list[tuple[int, int]]:
    few, many = [r for r in rows if r["few"]], [r for r in rows if not r["few"]]
    if not few or not many:
        return []
    regs = [np.frombuffer(b"".join(r["registers"] for r in side), "<u2").reshape(-1, REGISTERS) for side in (few, many)]
    column = lambda side, c: np.array([r[c] for r in side])
    size = [np.array([len(r["hashes"]) for r in side], float) for side in (few, many)]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    picked = []
    band = rows[0]["band"]
    for at in range(0, len(few), 64):
        f = slice(at, at + 64)
        same = regs[0][f, None, :] == regs[1][None, :, :]
        agree = same.reshape(*same.shape[:2], -1, ROWS).all(3)
        ok = agree.any(2) & (agree.argmax(2) == band)  # compared in the first band of several
        ok &= column(few, "component")[f, None] != column(many, "component")[None, :]
        ok &= ~column(many, "outside")[None, :] | (column(few, "node")[f, None] < column(many, "node")[None, :])
        low, high = np.minimum(size[0][f, None], size[1][None, :]), np.maximum(size[0][f, None], size[1][None, :])
        ok &= 100 * low >= PERCENT * high
        x, y = np.nonzero(ok)
        if len(x):
            j = likely_jaccard(regs[0][f][x], regs[1][y], size[0][f][x], size[1][y])
            picked += [(-v, at + p, q) for v, p, q in zip(j, x.tolist(), y.tolist(), strict=True) if v >= LEAST_ESTIMATE]
    found = []
    for _, p, q in sorted(picked):
        a, b = few[p], many[q]
        if root(a["component"]) == root(b["component"]):
            continue
        both = len(np.intersect1d(a["hashes"], b["hashes"], assume_unique=True))
        if 100 * both >= PERCENT * (len(a["hashes"]) + len(b["hashes"]) - both):
            parent[root(a["component"])] = root(b["component"])
            found.append((a["node"], b["node"]))
    return found


def op6_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
