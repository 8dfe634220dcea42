"""Queries of search and evaluation: documents are chunks, embeddings their vectors, equal texts copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.functions import text
from spandrel.functions.lineage import cut
from spandrel.operators import metrics, search
from spandrel.plans.common import query, read, spread

WORDS = search.query_terms("The worthless with license token passwords")
QUERY_VECTOR = 7

# RE2 has no lookahead: identifiers and dates are left out of this form, and the driver's texts hold none.
_TOKENS = f"list_filter(regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '\\d+(?:\\.\\d+)+|[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({text.STOP_WORDS}, w))"
_V, _NOT_V = f"[{text.VOWELS}]", f"[^{text.VOWELS}]"
_STEMS = f"""
st0 AS (SELECT word, length(regexp_extract(word, '^{_NOT_V}*{_V}+{_NOT_V}')) AS until FROM (SELECT DISTINCT word FROM tfw)),
st1 AS (SELECT *, greatest(until, 3) + 1 AS r, substr(word, 1, length(word) - 2) AS head FROM st0),
st2 AS (SELECT *, length(regexp_extract(substr(word, r), '(?:{"|".join(text.ENDINGS)})$')) AS e FROM st1),
st3 AS (SELECT *, CASE WHEN e > 0 THEN substr(word, 1, length(word) - e) WHEN ends_with(substr(word, r), 'et') AND regexp_matches(head, '{_V}.*{_NOT_V}$') AND NOT regexp_matches(head, '(?:{"|".join(text.KEEP_ET)})$') THEN head
  WHEN ends_with(substr(word, r), 's') AND regexp_matches(word, '[{text.S_ENDING}]s$') THEN substr(word, 1, length(word) - 1) ELSE word END AS one FROM st2),
st4 AS (SELECT *, CASE WHEN regexp_matches(substr(one, r), '(?:dd|gd|nn|[dgkt]t)$') THEN substr(one, 1, length(one) - 1) ELSE one END AS two FROM st3),
st5 AS (SELECT *, CASE WHEN regexp_matches(substr(two, r), '(?:fullt|löst)$') THEN substr(two, 1, length(two) - 1) ELSE substr(two, 1, length(two) - length(regexp_extract(substr(two, r), '(?:lig|els|ig)$'))) END AS three FROM st4),
stems AS (SELECT word, CASE WHEN until > 0 AND regexp_matches(word, '^\\p{{L}}+$') THEN three ELSE word END AS term FROM st5)"""
_POSTINGS = f"""
chunks AS (SELECT doc_id AS chunk, {_TOKENS} AS terms FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(terms)) AS avg_length FROM chunks),
tfw AS (SELECT chunk, len(terms) AS length, word, count(*) AS tf FROM (SELECT chunk, terms, unnest(terms) AS word FROM chunks) GROUP BY ALL),{_STEMS},
tf AS (SELECT chunk, length, term, sum(tf) AS tf FROM tfw JOIN stems USING (word) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT chunk) AS chunk_count FROM tf GROUP BY term),
post AS (SELECT tf.term, chunk, ln(1 + (n - chunk_count + 0.5) / (chunk_count + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length)) AS weight
  FROM tf JOIN df ON tf.term = df.term, corpus)"""
_WANTED = ", ".join(f"'{w}'" for w in WORDS)
def _branches(within: str = "true", vec_within: str = "true") -> str:
    return f"""{_POSTINGS},
hashes AS (SELECT doc_id AS chunk, sha256(coalesce(text, '')) AS section_hash FROM documents),
kept AS (SELECT doc_id AS chunk FROM documents WHERE {within}),
text_all AS (SELECT chunk, round(sum(weight), 9) AS score FROM post WHERE term IN ({_WANTED}) AND chunk IN (SELECT chunk FROM kept) GROUP BY chunk),
text_top AS (SELECT chunk, row_number() OVER (ORDER BY score DESC, chunk) AS rank FROM text_all WHERE score > 0 ORDER BY score DESC, chunk LIMIT 100),
qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR}),
vec_all AS (SELECT vec_id AS chunk, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM embeddings, qv WHERE {vec_within}),
vec_top AS (SELECT chunk, score, row_number() OVER (ORDER BY score DESC, chunk) AS rank FROM vec_all ORDER BY score DESC, chunk LIMIT 100),
t AS (SELECT section_hash, arg_min(chunk, rank) AS chunk, row_number() OVER (ORDER BY min(rank)) AS rank FROM text_top JOIN hashes USING (chunk) GROUP BY section_hash),
v AS (SELECT section_hash, arg_min(chunk, rank) AS chunk, row_number() OVER (ORDER BY min(rank)) AS rank FROM vec_top JOIN hashes USING (chunk) GROUP BY section_hash),
fused AS (SELECT section_hash, CASE WHEN t.rank IS NULL OR v.rank <= t.rank THEN v.chunk ELSE t.chunk END AS chunk,
  round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + t.rank), 0), 12) AS score FROM v FULL JOIN t USING (section_hash)),
hits AS (SELECT * FROM fused ORDER BY score DESC, chunk LIMIT 8)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("chunk"), text.analysed(F.col("text")).alias("terms"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("section_hash"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = QUERY_VECTOR) -> list[float]:
    return [float(x) for x in read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def literal_vector(values: list[float]):
    return F.array(*[F.lit(x) for x in values])


def _hybrid(spark: SparkSession, sf_dir: str, within: DataFrame | None = None) -> DataFrame:
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "text")
    found = search.hybrid(search.query_postings(chunks(spark, sf_dir), WORDS), vectors(spark, sf_dir), texts, WORDS, literal_vector(query_vector(spark, sf_dir)), within=within, hash_of=F.sha2(F.coalesce("text", F.lit("")), 256))
    return found.select("section_hash", "chunk", "score")


@query(f"""WITH {_branches()}
SELECT hits.chunk, hits.section_hash, score, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM hits JOIN documents ON doc_id = chunk""")
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 and exact vectors, fused over copies; details are joined to the hits alone."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "lang", "source", F.length("text").cast("long").alias("n_chars"))
    return docs.join(F.broadcast(_hybrid(spark, sf_dir)), "chunk").select("chunk", "section_hash", "score", "lang", "source", "n_chars")


@query(f"""WITH {_branches()}
SELECT DISTINCT hits.section_hash, hits.chunk, h.chunk AS copy FROM hits JOIN hashes h ON h.section_hash = hits.section_hash AND h.chunk <> hits.chunk""")
def search_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other documents with a hit's text."""
    return search.copies(_hybrid(spark, sf_dir), hashes(spark, sf_dir))


_IN_SCOPE = "doc_id % 3 = 1 AND (doc_id % 4 <> 0 OR doc_id % 5 = 2) AND lang = 'en'"


@query(f"""WITH {_branches(_IN_SCOPE, f"vec_id IN (SELECT doc_id FROM documents WHERE {_IN_SCOPE})")}
SELECT chunk, section_hash, score FROM hits""")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search within an area, an agreement and a document type; the filters come before both rankings."""
    k = F.col("doc_id")
    scope = read(spark, sf_dir, "documents").select(
        k.alias("chunk"),
        F.array(F.concat(F.lit("area "), (k % 3).cast("string"))).alias("framework_areas"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A-1"))).alias("agreement_numbers"),
        F.array(F.concat(F.lit("P-"), (k % 5).cast("string"))).alias("procurement_numbers"),
        F.col("lang").alias("document_type"),
    )
    return _hybrid(spark, sf_dir, scope.filter(search.scope_filter(areas="area 1", agreement="A-1", agreement_procurement="P-2", document_type="en"))).select("chunk", "section_hash", "score")


@query(f"WITH {_POSTINGS} SELECT term, chunk, round(weight, 8) AS weight FROM post")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 weight of every stem in every document."""
    c = chunks(spark, sf_dir)
    counts = search.stem_counts(c)
    words = search.vocabulary(counts)
    return search.postings(counts, search.corpus_of(c, words), vocabulary_=words).select("term", "chunk", F.round("weight", 8).alias("weight"))


@query(f"""WITH {_POSTINGS} SELECT term, chunk_count, row_number() OVER (ORDER BY term) - 1 AS id,
round(ln(1 + (n - chunk_count + 0.5) / (chunk_count + 0.5)), 9) AS idf FROM df, corpus""")
def bm25_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency, dense id and inverse document frequency of every stem."""
    c = chunks(spark, sf_dir)
    words = search.vocabulary(search.stem_counts(c))
    return search.with_dense_id(words.select("term", "chunk_count"), "term", "id").join(F.broadcast(search.corpus_of(c, words))).select("term", "chunk_count", "id", F.round(search.idf(F.col("n"), F.col("chunk_count")), 9).alias("idf"))


@query(f"""WITH {_POSTINGS}, s AS (SELECT chunk, round(sum(weight), 9) AS score FROM post WHERE term IN ({_WANTED}) GROUP BY chunk)
SELECT chunk, score, CAST(row_number() OVER (ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM s WHERE score > 0 ORDER BY score DESC, chunk LIMIT 50""")
def bm25_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 documents by BM25."""
    return search.text_candidates(search.query_postings(chunks(spark, sf_dir), WORDS), WORDS, 50)


@query(f"""WITH qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR}),
s AS (SELECT vec_id AS chunk, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM embeddings, qv WHERE label IN (1, 2, 3))
SELECT chunk, score, CAST(row_number() OVER (ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM s ORDER BY score DESC, chunk LIMIT 50""")
def vector_candidates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 vectors within a filter, which comes before the ranking."""
    kept = vectors(spark, sf_dir).filter(F.col("label").isin(1, 2, 3))
    return search.vector_candidates(kept, literal_vector(query_vector(spark, sf_dir)), 50)


@query("""SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length,
round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings""")
def vectors_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at length one."""
    v = read(spark, sf_dir, "embeddings").withColumn("unit", search.l2_normalised(F.col("embedding")))
    return v.select("vec_id", F.round(F.sqrt(search.inner_product(F.col("embedding"), F.col("embedding"))), 6).alias("length"), F.round(F.col("unit")[0], 6).alias("first"))


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions are the vectors divisible by 100; required sources the three nearest vectors of their own label; the ranking goes by the first 32 components."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    scored = cut(search.nearest(v.filter(F.col("vec_id") % 100 == 0), v, 32, 10, 3))
    rank = lambda by: F.row_number().over(Window.partitionBy("question").orderBy(F.desc(by), "vec_id"))
    ranking = scored.withColumn("rank", rank("coarse")).filter("rank <= 10").select("question", "rank", F.col("vec_id").alias("key"))
    required = scored.filter("same").withColumn("source_id", rank("fine")).filter("source_id <= 3").select("question", "source_id", F.col("vec_id").alias("key"))
    return ranking, required


_GOLD = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS question, v.vec_id, v.label, q.label AS q_label, round(list_inner_product(q.e[1:32], v.e[1:32]), 9) AS coarse, round(list_inner_product(q.e, v.e), 9) AS fine
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
ranking AS (SELECT * FROM (SELECT question, row_number() OVER (PARTITION BY question ORDER BY coarse DESC, vec_id) AS rank, vec_id AS key FROM s) WHERE rank <= 10),
required AS (SELECT * FROM (SELECT question, row_number() OVER (PARTITION BY question ORDER BY fine DESC, vec_id) AS source_id, vec_id AS key FROM s WHERE label = q_label) WHERE source_id <= 3),
firsts AS (SELECT r.question, r.source_id, min(k.rank) AS rank FROM required r LEFT JOIN ranking k ON k.question = r.question AND k.key = r.key GROUP BY ALL),
m AS (SELECT question, round(count(rank) / count(*), 9) AS recall, count(rank) = count(*) AS all_hit, round(coalesce(1.0 / min(rank), 0), 9) AS reciprocal_rank,
  round(sum(coalesce(1 / log2(1 + rank), 0)) / list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda i: 1 / log2(1 + i))), 9) AS ndcg FROM firsts GROUP BY question)"""


@query(f"WITH {_GOLD} SELECT * FROM m")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, all-hit, reciprocal rank and nDCG at 10 per question."""
    return metrics.ranking_metrics(*_gold(spark, sf_dir))


@query(f"""WITH {_GOLD} SELECT question % 4 AS category, CAST(count(*) AS BIGINT) AS questions, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY 1""")
def retrieval_metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics per category of questions."""
    m = metrics.ranking_metrics(*_gold(spark, sf_dir)).withColumn("category", F.col("question") % 4)
    return m.groupBy("category").agg(F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(f"WITH {_GOLD} SELECT question, source_id, CAST(coalesce(rank, 0) AS BIGINT) AS rank FROM firsts")
def retrieval_first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank at which each required source is first found; 0 if it isn't."""
    found = metrics.first_ranks(*_gold(spark, sf_dir), 10)
    return found.select("question", F.col("source_id").cast("long").alias("source_id"), F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


@query(f"""WITH {_GOLD}, d AS (SELECT question, ndcg - reciprocal_rank AS d FROM m),
u AS (SELECT r, d, CAST('0x' || substr(md5('0:' || CAST(question AS VARCHAR) || ':' || CAST(r AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM d, range(0, 500) AS t(r)),
w AS (SELECT r, d, CAST(u >= 0.36787944117144233 AS INT) + CAST(u >= 0.7357588823428847 AS INT) + CAST(u >= 0.9196986029286058 AS INT) + CAST(u >= 0.9810118431238462 AS INT) + CAST(u >= 0.9963401531726563 AS INT) + CAST(u >= 0.9994058151824183 AS INT) + CAST(u >= 0.9999167588507119 AS INT) + CAST(u >= 0.9999897508033253 AS INT) AS w FROM u),
bs AS (SELECT r, sum(w * d) / sum(w) AS mean FROM w GROUP BY r HAVING sum(w) > 0)
SELECT 'ndcg - reciprocal rank' AS comparison, (SELECT round(avg(d), 9) FROM d) AS mean, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM bs""")
def paired_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean difference of two rankings' nDCG and its bootstrap interval."""
    m = metrics.ranking_metrics(*_gold(spark, sf_dir))
    pairs = m.select(F.lit("ndcg - reciprocal rank").alias("comparison"), "question", F.col("reciprocal_rank").alias("a"), F.col("ndcg").alias("b"))
    return metrics.paired_bootstrap(pairs, ["comparison"], 500)


@query("""WITH r AS (SELECT user_id % 5 AS run, event_type, value FROM events)
SELECT run, count(*) AS calls, count(DISTINCT event_type) AS kinds, round(median(value), 6) AS median, round(CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS DOUBLE), 6) AS p90,
round(max(value), 6) AS longest, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END), 6) AS share FROM r GROUP BY run""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts, median and nearest-rank percentile per run."""
    r = read(spark, sf_dir, "events").withColumn("run", F.col("user_id") % 5)
    bought = F.col("event_type") == "purchase"
    return r.groupBy("run").agg(
        F.count("*").alias("calls"),
        F.count_distinct("event_type").alias("kinds"),
        F.round(F.median("value"), 6).alias("median"),
        F.expr("round(cast(percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS double), 6)").alias("p90"),
        F.round(F.max("value"), 6).alias("longest"),
        F.count_if(bought).alias("purchases"),
        F.round(F.avg(F.when(bought, 1.0).otherwise(0.0)), 6).alias("share"),
    )


@query("""WITH t AS (SELECT user_id % 7 AS thread, event_type AS model, event_id % 900 AS input_tokens, event_id % 300 AS cached_tokens, event_id % 120 AS output_tokens FROM events),
p(model, input, cached, output) AS (VALUES ('click', 2.0, 0.5, 8.0), ('view', 1.0, 0.1, 4.0), ('purchase', 5.0, 0.5, 20.0))
SELECT thread, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
CASE WHEN bool_and(input IS NOT NULL) THEN round(CAST(sum(((input_tokens - cached_tokens) * input + cached_tokens * input * cached + output_tokens * output) / 1e6) AS DOUBLE), 6) END AS cost
FROM t LEFT JOIN p USING (model) GROUP BY thread""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost per thread; null where a model has no price."""
    e = read(spark, sf_dir, "events")
    t = e.select((F.col("user_id") % 7).alias("thread"), F.col("event_type").alias("model"), (F.col("event_id") % 900).alias("input_tokens"), (F.col("event_id") % 300).alias("cached_tokens"), (F.col("event_id") % 120).alias("output_tokens"))
    p = spark.createDataFrame([("click", 2.0, 0.5, 8.0), ("view", 1.0, 0.1, 4.0), ("purchase", 5.0, 0.5, 20.0)], "model string, input double, cached double, output double")
    return metrics.cost(t, p, ["thread"])
