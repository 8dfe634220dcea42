"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import forget, written

#: Nodes with more neighbours than this are joined by broadcast: so many, those with the most neighbours.
HOT, HOT_NODES = 1000, 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node that can be reached.

    Alternating large and small stars (Kiveris et al. 2014). A star's minimum is
    aggregated first and joined back, so a node with very many neighbours is
    never gathered in one task; each round is written to the shared folder.
    """
    now = _stars(edges.filter("u <> v"))
    seen = None
    while (mark := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()) != seen:
        seen, before = mark, now
        now = _stars(before)
        forget(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the smallest of u's neighbours. The edges of a node with very many don't meet in one task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_"))
    hot = least.filter(F.col("n_") > HOT).orderBy(F.desc("n_"), "u").limit(HOT_NODES).select("u", "m").collect()
    if not hot:
        return edges.join(least.drop("n_"), "u")
    few = F.broadcast(edges.sparkSession.createDataFrame(hot, "u long, m long"))
    return edges.join(few, "u").unionByName(edges.join(few.select("u"), "u", "left_anti").join(least.drop("n_"), "u"))


def _stars(edges: DataFrame) -> DataFrame:
    both = _with_least(edges.select("u", "v").union(edges.select("v", "u")).select(F.col("u").cast("long"), F.col("v").cast("long")))
    both = both.withColumn("m", F.least("u", "m"))
    large = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "stars")
    met = _with_least(down)
    small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(met.select("u", "m").distinct()).distinct()
    found = written(small, "stars")
    forget(down)
    return found
