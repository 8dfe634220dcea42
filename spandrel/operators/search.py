"""Hybrid search: BM25 postings, exact dense vectors, reciprocal rank fusion over copies.

Filters come before ranking in both branches. Keys are ranked first; titles and
texts are joined to the few that are left. Every order ends in the key columns.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions import text
from spandrel.functions.text import stem
from spandrel.functions.lineage import cut, small_enough

K1, B = 1.2, 0.75
RRF_K = 60


def term_counts(chunks: DataFrame, key: str = "chunk", terms: str = "terms") -> DataFrame:
    """(key, length, term, tf) of chunks (key, array of terms): how often each term is in each."""
    return chunks.select(key, F.size(terms).alias("length"), F.explode(terms).alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def stems(counts: DataFrame, key: str = "chunk") -> DataFrame:
    """term_counts() with stems for terms. Distinct terms are stemmed and joined back."""
    stemmed = counts.select("term").distinct().withColumn("stem", text.stemmed(F.col("term")))
    return counts.join(stemmed, "term").groupBy(key, "length", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


@F.arrow_udf(T.StructType([T.StructField("term", T.ArrayType(T.StringType())), T.StructField("tf", T.ArrayType(T.IntegerType()))]))
def _stems_counted(terms: pa.Array) -> pa.Array:
    """The distinct stems of each row's terms, and how often each is there. Each distinct term of a batch is stemmed once."""
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(terms), dtype=np.int64), lengths)
    coded = pc.dictionary_encode(terms.flatten())
    known = coded.dictionary.cast(pa.string()).to_pylist()
    stemmed = pa.array([stem(w) if w.isalpha() else w for w in known], pa.string()).dictionary_encode()
    codes = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    row, codes = row[codes >= 0], codes[codes >= 0]
    width = max(1, len(stemmed.dictionary))
    pairs, tf = np.unique(row * width + stemmed.indices.to_numpy(zero_copy_only=False)[codes], return_counts=True)
    ends = np.searchsorted(pairs, np.arange(len(terms) + 1, dtype=np.int64) * width)
    lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), x) for x in (stemmed.dictionary.take(pa.array(pairs % width)), pa.array(tf.astype(np.int32)))]
    return pa.StructArray.from_arrays(lists, ["term", "tf"])


def stem_counts(chunks: DataFrame, key: str = "chunk", terms: str = "terms") -> DataFrame:
    """stems(term_counts(chunks)). A chunk's stems are counted within its row, and kept as a checkpoint, as texts are dear to analyse; rows of one key meet only if a key is there twice."""
    rows = cut(chunks.select(key, F.size(terms).alias("length"), _stems_counted(terms).alias("counted_")).select(key, "length", "counted_.*"))
    counts = rows.select(key, "length", F.inline(F.arrays_zip("term", "tf"))).withColumn("tf", F.col("tf").cast("long"))
    repeated = not rows.groupBy(key).agg(F.count("*").alias("n_")).filter("n_ > 1").isEmpty()
    return counts.groupBy(key, "length", "term").agg(F.sum("tf").alias("tf")) if repeated else counts


def corpus(chunks: DataFrame, terms: str = "terms") -> DataFrame:
    """One row (n, avg_length)."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(terms)).alias("avg_length"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(term, chunk_count, total) of term_counts(): in how many chunks each term is, and how often in all; as a checkpoint, since texts are dear to read again."""
    return cut(counts.groupBy("term").agg(F.count("*").alias("chunk_count"), F.sum("tf").alias("total")))


def corpus_of(chunks: DataFrame, vocabulary_: DataFrame) -> DataFrame:
    """corpus() from the vocabulary() of chunks without null terms: no text is read for it."""
    total = vocabulary_.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total_"))
    return chunks.agg(F.count("*").alias("n")).join(total).select("n", F.try_divide(F.col("total_").cast("double"), F.col("n").cast("double")).alias("avg_length"))


def term_index(counts: DataFrame) -> DataFrame:
    """(term, chunk_count, id) of term_counts(), with dense ids in term order.

    The ids are given per range of terms and then shifted, so that no task sorts all terms.
    """
    return with_dense_id(vocabulary(counts).select("term", "chunk_count"), "term", "id")


def with_dense_id(df: DataFrame, by: str, out: str, buckets: int = 64) -> DataFrame:
    """df with out: 0-based position in the order of the distinct values of by, numbered in ranges of about equal size, at most `buckets`.

    The ranges are kept as a checkpoint, as a second sample of splitters might differ.
    """
    bucketed = cut(df.repartitionByRange(buckets, by).withColumn("bucket_", F.spark_partition_id()))
    sizes = bucketed.groupBy("bucket_").agg(F.count("*").alias("n_"))
    before = sizes.withColumn("before_", F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))).drop("n_")
    rank = F.row_number().over(Window.partitionBy("bucket_").orderBy(by))
    return bucketed.withColumn("rank_", rank).join(F.broadcast(before), "bucket_").withColumn(out, (F.col("rank_") - 1 + F.coalesce("before_", F.lit(0))).cast("long")).drop("bucket_", "rank_", "before_")


def query_terms(question: str) -> list[str]:
    """The distinct stems of a question, in the order in which they appear."""
    found = re.findall(text.TOKEN.replace("(?U)", "").replace(r"[\p{L}\p{N}]", r"[^\W_]"), unicodedata.normalize("NFC", question).lower())
    return list(dict.fromkeys(text.stem(w) if w.isalpha() else w for w in found if w not in text.STOP_WORDS))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, length: Column, avg_length: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


#: Most terms that are broadcast.
TERMS = 1_000_000


def postings(counts: DataFrame, corpus_: DataFrame, key: str = "chunk", vocabulary_: DataFrame | None = None) -> DataFrame:
    """(term, key, weight): the BM25 weight of every term of every chunk, from term_counts() and corpus(), and vocabulary() where it is there already."""
    if vocabulary_ is None:
        df = counts.groupBy("term").agg(F.count("*").alias("chunk_count"))
    else:
        df = vocabulary_.select("term", "chunk_count")
        df = F.broadcast(df) if small_enough(df, TERMS) else df
    # corpus is one row.
    return counts.join(df, "term").join(F.broadcast(corpus_)).select("term", key, bm25_weight(F.col("tf"), F.col("length"), F.col("avg_length"), idf(F.col("n"), F.col("chunk_count"))).alias("weight"))


def query_postings(chunks: DataFrame, wanted: list[str], key: str = "chunk", terms: str = "terms") -> DataFrame:
    """postings() of the stems in `wanted` alone, of chunks with analysed terms. A stem is the beginning of its words: no other word is stemmed."""
    near = F.filter(terms, lambda t: reduce(lambda a, b: a | b, [t.startswith(w) for w in wanted], F.lit(False)))
    # Texts are analysed once: few terms of a chunk are near.
    met = cut(chunks.select(key, F.size(terms).alias("length"), near.alias("near_")))
    words = met.select(key, "length", F.explode("near_").alias("word"))
    # No more than the endings that each wanted stem can have.
    forms = words.select("word").distinct().withColumn("term", text.stemmed(F.col("word"))).filter(F.col("term").isin(wanted))
    counts = words.join(F.broadcast(forms), "word").groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    return postings(counts, met.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length")), key)


def text_candidates(weights: DataFrame, query_terms: list[str], n: int, key: str = "chunk") -> DataFrame:
    """(key, score, rank): the n best chunks by the sum of the weights of the query's distinct terms."""
    scored = weights.filter(F.col("term").isin(sorted(set(query_terms)))).groupBy(key).agg(F.round(F.sum("weight"), 9).alias("score")).filter("score > 0")
    return ranked(scored, n, key)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """The vector at length one; null if it is zero or has a component that isn't finite."""
    length = F.sqrt(inner_product(v, v))
    return F.when((length > 0) & (length < float("inf")), F.transform(v, lambda x: x.cast("double") / length))


def vector_candidates(vectors: DataFrame, query: Column, n: int, key: str = "chunk", vector: str = "embedding") -> DataFrame:
    """(key, score, rank): the n chunks of largest inner product with the query vector."""
    return ranked(vectors.select(key, F.round(inner_product(F.col(vector), query), 9).alias("score")), n, key)


#: Most questions that are broadcast, or meet the candidates in one block.
QUESTIONS = 2048


def in_blocks(questions: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Every question with every candidate; questions beyond a broadcast go in blocks, to each of which the candidates are sent once."""
    blocks = max(1, -(-questions.count() // QUESTIONS))
    if blocks == 1:
        return candidates.join(F.broadcast(questions))
    placed = questions.withColumn("block_", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return candidates.withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(placed, "block_").drop("block_")


#: Candidates of one block of scores, and questions scored at once.
CANDIDATES, AT_ONCE = 16_384, 256


def nearest(questions: DataFrame, candidates: DataFrame, coarse: int, n_coarse: int, n_fine: int) -> DataFrame:
    """(question, vec_id, same, coarse, fine): pairs among which each question's nearest vectors are, with their inner products.

    questions, candidates: (vec_id, embedding, label). coarse is the product of the
    first `coarse` components, and the n_coarse best by it, rounded to 9 digits, are
    there; fine is the whole product, and the n_fine best of the question's own label
    are there. All pairs are scored, in blocks of bounded size; a pair leaves its
    block only if its score may be among the best there. Vectors that are null or
    irregular meet everything.
    """
    count = lambda d, most: max(1, -(-d.count() // most))
    blocks, parts = count(questions, QUESTIONS), count(candidates, CANDIDATES)
    place = lambda d, n, name: d.withColumn(name, F.pmod(F.xxhash64(d.columns[0]), F.lit(n)).cast("int"))
    spread_ = lambda d, n, name: d.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    asked = questions.select("vec_id", "embedding", "label").toDF("question", "q", "q_label")
    q = spread_(place(asked, blocks, "q_block_"), parts, "q_part_").groupBy("q_block_", "q_part_")
    c = spread_(place(candidates.select("vec_id", "embedding", "label"), parts, "part_"), blocks, "block_").groupBy("block_", "part_")
    key, label = (candidates.schema[f].dataType.simpleString() for f in ("vec_id", "label"))

    def vectors(column: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors as rows, and which of them are whole; the others are zero there."""
        rows = np.zeros((len(column), width))
        whole = np.zeros(len(column), dtype=bool)
        for i, v in enumerate(column):
            if v is not None and len(v) == width:
                rows[i] = v
                whole[i] = np.isfinite(rows[i]).all()
        rows[~whole] = 0.0
        return rows, whole

    def best(scores: np.ndarray, n: int, slack: np.ndarray) -> np.ndarray:
        if scores.shape[1] <= n:
            return scores > -np.inf
        least = np.partition(scores, -n, axis=1)[:, -n, None]
        return (scores >= least - slack) & (scores > -np.inf)

    def block(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return pd.DataFrame({n: [] for n in ("question", "q", "q_label", "vec_id", "embedding", "label")})
        width = next((len(v) for v in known["embedding"] if v is not None), 0)
        (a, a_whole), (b, b_whole) = vectors(asked["q"], width), vectors(known["embedding"], width)
        questions, q_labels = asked["question"].to_numpy(), asked["q_label"].to_numpy()
        ids, labels = known["vec_id"].to_numpy(), known["label"].to_numpy()
        longest = np.sqrt((b * b).sum(axis=1)).max(initial=0.0)
        found = []
        for start in range(0, len(asked), AT_ONCE):
            some, part = slice(start, start + AT_ONCE), a[start : start + AT_ONCE]
            other = questions[some, None] != ids[None, :]
            # More than rounding to 9 digits and the order of a sum can change.
            slack = 1e-8 + 1e-11 * np.sqrt((part * part).sum(axis=1))[:, None] * longest
            near = best(np.where(other & b_whole, part[:, :coarse] @ b[:, :coarse].T, -np.inf), n_coarse, slack)
            own = other & b_whole & (q_labels[some, None] == labels[None, :])
            near |= best(np.where(own, part @ b.T, -np.inf), n_fine, slack)
            i, j = np.nonzero(near | (other & ~(a_whole[some, None] & b_whole)))
            found.append((i + start, j))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=int) for k in (0, 1))
        return pd.DataFrame({"question": questions[i], "q": asked["q"].to_numpy()[i], "q_label": q_labels[i], "vec_id": ids[j], "embedding": known["embedding"].to_numpy()[j], "label": labels[j]})

    vector = candidates.schema["embedding"].dataType.simpleString()
    pairs = q.cogroup(c).applyInPandas(block, f"question {key}, q {vector}, q_label {label}, vec_id {key}, embedding {vector}, label {label}")
    start = lambda c: F.slice(c, 1, coarse)
    return pairs.select("question", "vec_id", (F.col("label") == F.col("q_label")).alias("same"), F.round(inner_product(start("q"), start("embedding")), 9).alias("coarse"), F.round(inner_product(F.col("q"), F.col("embedding")), 9).alias("fine"))


def ranked(scored: DataFrame, n: int, key: str) -> DataFrame:
    """The best n of scored (key, score), with their rank; ties go to the smaller key."""
    best = scored.orderBy(F.desc("score"), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def section_ranking(candidates: DataFrame, texts: DataFrame, key: str = "chunk", group: str = "section_hash", hash_of: Column | None = None) -> DataFrame:
    """(group, key, rank): the first chunk of each group of copies, ranked anew from 1. candidates: a limited ranking.

    texts holds the group of each key; or hash_of makes it, for the candidates alone.
    """
    met = F.broadcast(candidates).join(texts, key)
    met = met if hash_of is None else met.withColumn(group, hash_of)
    first = met.groupBy(group).agg(F.min_by(key, "rank").alias(key), F.min("rank").alias("first_"))
    return first.select(group, key, F.row_number().over(Window.orderBy("first_")).alias("rank"))


def fuse(vector: DataFrame, text: DataFrame, k: int = RRF_K, key: str = "chunk", group: str = "section_hash") -> DataFrame:
    """(group, key, score): reciprocal rank fusion of two section rankings; the better ranked chunk stands for its group, the vector's on a tie."""
    v = vector.select(group, F.col(key).alias("v_key"), F.col("rank").alias("v_rank"))
    t = text.select(group, F.col(key).alias("t_key"), F.col("rank").alias("t_rank"))
    both = v.join(t, group, "full_outer")
    score = F.coalesce(1 / (k + F.col("v_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("t_rank")), F.lit(0.0))
    own = F.when(F.col("t_rank").isNull() | (F.col("v_rank") <= F.col("t_rank")), F.col("v_key")).otherwise(F.col("t_key"))
    return both.select(group, own.alias(key), F.round(score, 12).alias("score"))


def hybrid(weights: DataFrame, vectors: DataFrame, texts: DataFrame, query_terms: list[str], query_vector: Column, limit: int = 8, candidates: int = 100, k: int = RRF_K, key: str = "chunk", group: str = "section_hash", within: DataFrame | None = None, hash_of: Column | None = None) -> DataFrame:
    """The `limit` best groups by both branches; of the chunks in `within` (key) alone, if given: filters come before ranking."""
    if within is not None:
        weights, vectors = (d.join(within.select(key), key, "left_semi") for d in (weights, vectors))
    v = section_ranking(vector_candidates(vectors, query_vector, candidates, key), texts, key, group, hash_of)
    t = section_ranking(text_candidates(weights, query_terms, candidates, key), texts, key, group, hash_of)
    return fuse(v, t, k, key, group).orderBy(F.desc("score"), key).limit(limit)


def copies(hits: DataFrame, hashes: DataFrame, key: str = "chunk", group: str = "section_hash") -> DataFrame:
    """(group, key, copy): the other chunks of each hit's group."""
    return F.broadcast(hits.select(group, key)).join(hashes.select(group, F.col(key).alias("copy")), group).filter(F.col("copy") != F.col(key)).distinct()


def scope_filter(areas: str | None = None, procurement: str | None = None, agreement: str | None = None, agreement_procurement: str | None = None, document_type: str | None = None) -> Column:
    """The conjunction of optional filters over a scope row.

    A file matches an agreement if it lists it, or lists none and lists the
    agreement's procurement; with an unknown procurement no shared file matches.
    """
    condition = F.lit(True)
    if areas is not None:
        condition &= F.array_contains("framework_areas", areas)
    if procurement is not None:
        condition &= F.array_contains("procurement_numbers", procurement)
    if document_type is not None:
        condition &= F.col("document_type").eqNullSafe(document_type)
    if agreement is not None:
        shared = F.array_contains("procurement_numbers", F.lit(agreement_procurement)) if agreement_procurement else F.lit(False)
        condition &= F.array_contains("agreement_numbers", agreement) | ((F.size("agreement_numbers") == 0) & shared)
    return condition


def section_relevance(sections: DataFrame, query_words: list[str], prefix: int = 6) -> DataFrame:
    """(doc, position, score): sections ranked by the rarity of the query's word beginnings in them, twice for the title.

    sections: (doc, position, title, text).
    """
    starts = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.substring(w, 1, prefix)))
    wanted = sorted({w.lower()[:prefix] for w in query_words})
    hits = sections.select("doc", "position", starts(F.col("title")).alias("in_title"), starts(F.concat_ws(" ", "title", "text")).alias("in_all")).select("doc", "position", "in_title", F.explode(F.array_intersect("in_all", F.array(*[F.lit(w) for w in wanted]))).alias("term"))
    total = sections.agg(F.count("*").alias("n"))
    rarity = hits.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("term", F.log1p(F.col("n") / F.col("df")).alias("idf"))
    weight = F.col("idf") * F.when(F.array_contains("in_title", F.col("term")), 2).otherwise(1)
    return hits.join(F.broadcast(rarity), "term").groupBy("doc", "position").agg(F.round(F.sum(weight), 9).alias("score"))
