"""Retrieval metrics, run summaries, costs and paired bootstrap intervals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_ranks(ranking: DataFrame, required: DataFrame, k: int) -> DataFrame:
    """(question, source_id, rank): the best rank up to k of any acceptable key of each required source; null if none.

    ranking: (question, rank, key); required: (question, source_id, key).
    """
    met = required.join(ranking.filter(F.col("rank") <= k).select("question", "key", "rank"), ["question", "key"], "left")
    return met.groupBy("question", "source_id").agg(F.min("rank").alias("rank"))


def ranking_metrics(ranking: DataFrame, required: DataFrame, k: int = 10) -> DataFrame:
    """(question, recall, all_hit, reciprocal_rank, ndcg) at k, per question with required sources."""
    ranks = first_ranks(ranking, required, k)
    gain = F.sum(F.coalesce(1 / F.log2(1 + F.col("rank")), F.lit(0.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.count("*").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(1 + i))
    return ranks.groupBy("question").agg(
        F.round(F.count("rank") / F.count("*"), 9).alias("recall"),
        (F.count("rank") == F.count("*")).alias("all_hit"),
        F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 9).alias("reciprocal_rank"),
        F.round(gain / ideal, 9).alias("ndcg"),
    )


def cost(tokens: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """by, input, cached, output tokens, and their cost; null if a model's price is missing.

    tokens: (by..., model, input_tokens, cached_tokens, output_tokens); prices: (model, input, cached, output) per million.
    """
    priced = tokens.join(prices, "model", "left")
    own = ((F.col("input_tokens") - F.col("cached_tokens")) * F.col("input") + F.col("cached_tokens") * F.col("input") * F.col("cached") + F.col("output_tokens") * F.col("output")) / 1e6
    known = F.bool_and(F.col("input").isNotNull())
    return priced.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"), F.when(known, F.round(F.sum(own), 6)).alias("cost"))


#: P(X <= k) of a Poisson variable of mean 1, for k from 0.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def paired_bootstrap(pairs: DataFrame, by: list[str], resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """(by..., mean, low, high): the mean of b - a and the 95 % interval of its resampled means, per group of question scores (by, question, a, b).

    In a resample a question counts as often as a Poisson variable of mean 1 says,
    drawn from a hash of seed, question and resample (Chamandy et al. 2012): sums
    are aggregated before the shuffle, and no group is gathered.
    """
    d = pairs.select(*by, "question", (F.col("b") - F.col("a")).alias("d"))
    drawn = d.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("question").cast("string"), F.col("r").cast("string"))
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0
    drawn = drawn.withColumn("u", u).withColumn("w", sum(((F.col("u") >= p).cast("int") for p in _POISSON), F.lit(0)))
    means = drawn.groupBy(*by, "r").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    bounds = means.groupBy(*by).agg(F.round(F.percentile("m", 0.025), 9).alias("low"), F.round(F.percentile("m", 0.975), 9).alias("high"))
    return d.groupBy(*by).agg(F.round(F.avg("d"), 9).alias("mean")).join(bounds, by).select(*by, "mean", "low", "high")
