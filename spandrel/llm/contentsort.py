"""Exact deduplication by sorting on content.

White space is deleted from texts, and rows are range-partitioned by what is
left: sampled splitters cut the order of (leading bytes, digest of the whole,
length of the original, identifier). The splitters' texts are cut to the leading
bytes so that their size is bounded; the digest keeps texts apart that begin
alike, and length and identifier cut a group of equal texts, however many rows
it has, into as many partitions as its size asks for. Each partition is sorted
externally, so that equal texts are neighbours, and neighbours are compared in
full. The first of a run of equals is the one that stays. A run that reaches the
edge of its partition goes on in the next one if the texts at the edge are
equal, again in full; there are at most two such runs in a partition, and they
are settled from one small row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import small_batches, table, written

#: Bytes of a text that a splitter holds.
LEADING = 64
_RUNS = "row long, n long, sha binary, part int, run long, keep_row long, keep_n long, size long, first boolean, last boolean, edge binary"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted partition, with the run of equal texts that each lies in.

    Holds identifiers, lengths and digests of one run, and the text of one row. A
    partition's first and last rows carry their text, for the comparison over its edges.
    """
    part, runs, text, opening = TaskContext.get().partitionId(), 0, None, None
    held = pa.table({"row": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "sha": pa.array([], pa.binary()), "new": pa.array([], pa.bool_())})

    def finished(t: pa.Table, last: bool) -> pa.Table:
        """t holds whole runs; last: nothing comes after them."""
        t = t.combine_chunks()
        new = t.column("new").to_numpy()
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        at = pa.array(np.repeat(starts, sizes))
        run = np.cumsum(new) - 1 + runs
        edges: list = [None] * len(new)
        if not runs:
            edges[0] = opening
        if last:
            edges[-1] = text
        columns = [t.column("row"), t.column("n"), t.column("sha"), np.full(len(new), part, np.int32), run, t.column("row").take(at), t.column("n").take(at), np.repeat(sizes, sizes), new, last & (run == run[-1]), pa.array(edges, pa.binary())]
        return pa.table(columns, [c.split()[0] for c in _RUNS.split(", ")])

    for b in batches:
        if not b.num_rows:
            continue
        texts = b.column("norm")
        differs = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        new = np.append([text is None or texts[0].as_py() != text], differs).astype(bool)
        opening = texts[0].as_py() if opening is None else opening
        text = texts[-1].as_py()
        before = held.num_rows
        held = pa.concat_tables([held, pa.table([b.column("row"), b.column("n"), b.column("sha"), new], held.column_names)])
        cut = before + int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            done = finished(held.slice(0, cut), False)
            yield from done.to_batches()
            runs, held = done.column("run")[-1].as_py() + 1, held.slice(cut)
    if held.num_rows:
        yield from finished(held, True).to_batches()


def sorted_runs(rows: DataFrame) -> DataFrame:
    """rows (row, text) in content order, each with its run of equal texts and, as far as its own partition goes, who stays and how many there are."""
    norm = normalised(F.col("text"))
    keyed = rows.select(F.col("row").cast("long"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), norm.cast("binary").alias("norm"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    keyed = keyed.withColumn("lead", F.substring("norm", 1, LEADING))
    order = ["lead", "sha", F.desc("n"), F.col("row").asc_nulls_last()]
    return small_batches(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n", "sha", "norm")).mapInArrow(_runs, _RUNS)


def _chains(runs: DataFrame) -> DataFrame:
    """(part, run, chain_row, chain_size, leads) of the runs that go over an edge: at most two per partition.

    The edges' texts are compared on the executors; the driver gets two short
    rows per partition, of which there are as many as shuffle partitions.
    """
    spark = runs.sparkSession
    edges = runs.filter("edge IS NOT NULL").groupBy("part", "run").agg(F.first("keep_row").alias("keep_row"), F.first("size").alias("size"), F.first("last").alias("last"), F.first("edge").alias("text"))
    ends = {(r["part"], r["run"]): r for r in edges.drop("text").collect()}
    parts = sorted({part for part, _ in ends})
    found = []
    if len(parts) > 1:
        after = F.broadcast(spark.createDataFrame(list(zip(parts[:-1], parts[1:], strict=True)), "part int, next int"))
        begins = edges.filter("run = 0").select(F.col("part").alias("next"), F.col("text").alias("begins"))
        met = edges.filter("last").join(after, "part").join(begins, "next").filter(F.col("text") == F.col("begins"))
        goes_on = {r["part"]: r["next"] for r in met.select("part", "next").collect()}
        final = {part: run for (part, run), r in ends.items() if r["last"]}
        chain: list[tuple[int, int]] = []
        for part in parts:
            chain = chain or [(part, final[part])]
            if part in goes_on:
                chain.append((goes_on[part], 0))
                if final[goes_on[part]] == 0:
                    continue  # one run fills the next partition, and may go on beyond it
            if len(chain) > 1:
                size = sum(ends[c]["size"] for c in chain)
                found += [(*c, ends[chain[0]]["keep_row"], size, k == 0) for k, c in enumerate(chain)]
            chain = []
    return spark.createDataFrame(found, "part int, run long, chain_row long, chain_size long, leads boolean")


def groups(rows: DataFrame) -> DataFrame:
    """(row, n_chars, keep_row, group_size, kept, text_sha256) for each of rows (row, text).

    Texts are equal if they are identical without ASCII white space; null counts
    as empty, and empty texts are equal. Of equals the row with the longest
    original text stays, then the one with the smallest identifier; a null
    identifier comes after all others. One row of a group stays, also if
    identifiers repeat. An empty table gives no rows.
    """
    runs = written(sorted_runs(rows), "runs")
    chains = F.broadcast(_chains(runs))
    met = runs.drop("edge").join(chains, ["part", "run"], "left")
    own = lambda name, chained: F.when(F.col("leads").isNull(), F.col(name)).otherwise(F.col(chained))
    return met.select(
        "row",
        F.col("n").alias("n_chars"),
        own("keep_row", "chain_row").alias("keep_row"),
        F.coalesce("chain_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce("leads", F.lit(True))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of documents that stay, with all their columns. Of rows that also share identifier and length, any one stays."""
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    sha = F.sha2(normalised(F.col(f"w.`{text}`")), 256)
    stays = groups(documents.select(F.col(f"`{key}`").alias("row"), F.col(f"`{text}`").alias("text"))).filter("kept")
    rows = documents.select(whole.alias("w")).withColumns({"k": F.col(f"w.`{key}`").cast("long"), "l": F.length(F.coalesce(f"w.`{text}`", F.lit(""))).cast("long"), "s": sha})
    met = rows.join(stays, F.col("k").eqNullSafe(F.col("row")) & (F.col("l") == F.col("n_chars")) & (F.col("s") == F.col("text_sha256")), "left_semi")
    return met.dropDuplicates(["k", "l", "s"]).select("w.*")


def op12_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "text"))
    return found.select(F.col("row").alias("doc_id"), F.col("keep_row").alias("keep_id"), "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
"""
