"""The cascade of reference rules over files made from orders: ten on a page, of eight types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import cascade
from spandrel.plans.common import query, read

#: Both engines read these expressions: sections of files, files j = 0..9 of a page p.
_SECTION = """o_orderkey AS position, o_orderkey % 50 AS p, CAST(floor(o_orderkey / 50) AS BIGINT) % 10 AS j,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN concat(o_orderkey % 3 + 1, '') ELSE concat(o_orderkey % 3 + 1, '.', o_orderkey % 7) END AS number,
  CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN o_orderkey % 4 = 0 THEN 'Vite' WHEN o_orderkey % 4 = 1 THEN 'Leverans.' WHEN o_orderkey % 4 = 2 THEN concat('Tvist ', o_orderkey % 3) ELSE concat('Pris ', CAST(floor(o_orderkey / 50) AS BIGINT) % 10) END AS title,
  concat('Datum: 2024-01-', lpad(concat(o_orderkey % 28 + 1, ''), 2, '0'), ' 10:00, svar 2024-03-01 10:00') AS text"""
_TITLE = """CASE j WHEN 0 THEN 'Frågor och svar - Anbudsinbjudan' WHEN 1 THEN 'Utkast till Anbudsinbjudan' WHEN 2 THEN 'Ansökningsinbjudan' WHEN 3 THEN 'Ändring av bilagorna 5.1-5.2' WHEN 7 THEN 'Allmänna villkor' WHEN 8 THEN 'Kravkatalog'
  WHEN 9 THEN 'Ramavtal' ELSE concat('Bilaga 5.', j - 3, ' Avtal') END"""
_TYPE = "CASE j WHEN 0 THEN 'questions_and_answers' WHEN 1 THEN 'procurement_document' WHEN 2 THEN 'procurement_document' WHEN 3 THEN 'amendment' WHEN 7 THEN 'general_terms' WHEN 8 THEN 'requirements' WHEN 9 THEN 'supplier_agreement' ELSE 'annex' END"
_PHRASE = "CASE position % 5 WHEN 0 THEN 'leverans av varor' WHEN 1 THEN 'vite' WHEN 2 THEN concat('tvist ', position % 4, ' ska lösas') ELSE concat('pris ', position % 11, ':') END"
_NAMED = "CASE position % 3 WHEN 0 THEN 'allmänna villkor' WHEN 1 THEN 'kravkatalog' ELSE 'upphandlingsdokumenten' END"
_NUMBER = "concat(position % 4 + 1, '.', position % 7)"
_KINDS = ("section", "section", "title", "annex", "annex_name", "document", "question", "law")
_KEYS = (_NUMBER, _NUMBER, _PHRASE, "concat('5.', position % 4 + 1)", "'kravkatalog för tjänster'", _NAMED, "concat(position % 3 + 1, '')", "'2016:1145'")
_GIVEN = ("''", "'allmänna villkor'", *["''"] * 6)

_CASCADE = f"""
s AS (SELECT *, p * 10 + j AS doc FROM (SELECT {_SECTION} FROM orders)),
f AS (SELECT DISTINCT doc, p, j, CASE j WHEN 1 THEN DATE '2024-01-01' + CAST(p % 25 AS INTEGER) WHEN 2 THEN DATE '2024-01-11' END AS pub FROM s),
l AS (SELECT p AS page, doc, j FROM f UNION SELECT (p + 1) % 50, doc, j FROM f WHERE j = 7),
h AS (SELECT doc, position, number, level, lower(rtrim(title, '.')) AS head FROM s),
numbered AS (SELECT doc, number, min(position) AS tp FROM s WHERE number IS NOT NULL GROUP BY ALL),
m0 AS (SELECT doc, j, position, number AS own, DATE '2024-01-01' + CAST(position % 28 AS INTEGER) AS day, unnest([{', '.join(f"'{k}'" for k in _KINDS)}]) AS kind, unnest([{', '.join(_KEYS)}]) AS key, unnest([{', '.join(_GIVEN)}]) AS named FROM s),
m AS (SELECT *, CASE WHEN kind <> 'title' THEN NULL WHEN position % 5 = 0 THEN 'leverans' WHEN position % 5 = 1 THEN 'vite' WHEN position % 5 = 2 THEN 'tvist ' || CAST(position % 4 AS VARCHAR) ELSE 'pris ' || CAST(position % 11 AS VARCHAR) END AS head FROM m0),
pg AS (SELECT m.*, l.page FROM m JOIN l USING (doc)),
on_ AS (SELECT l.page, f.doc AS td, f.j AS tj, f.pub FROM l JOIN f USING (doc)),
nearest AS (SELECT m.doc, m.position, m.kind, m.key, m.named, h.position AS tp, h.level, CASE WHEN own IS NULL OR h.number IS NULL OR string_split(own, '.')[1] <> string_split(h.number, '.')[1] THEN 0 WHEN string_split(own, '.')[2] = string_split(h.number, '.')[2] THEN 2 ELSE 1 END AS shared
  FROM m JOIN h ON h.doc = m.doc AND h.head = m.head),
near2 AS (SELECT *, max(shared) OVER w AS most FROM nearest WINDOW w AS (PARTITION BY doc, position, kind, key, named)),
near3 AS (SELECT *, min(level) OVER w AS low FROM near2 WHERE shared = most WINDOW w AS (PARTITION BY doc, position, kind, key, named)),
c AS (
  SELECT doc, j, day, position, kind, key, named, 1 AS ord, 'R2' AS rule, -1 AS page, 1 AS tier, NULL::DATE AS pub, doc AS td, NULL::BIGINT AS tp, false AS tender FROM m WHERE kind = 'document' AND (key = 'allmänna villkor' AND j = 7 OR key = 'kravkatalog' AND j = 8 OR key = 'upphandlingsdokumenten' AND j IN (1, 2))
  UNION ALL SELECT doc, j, day, position, kind, key, named, 4, 'R2', page, 1, pub, td, NULL, tj <> 0 FROM pg JOIN on_ USING (page) WHERE key = 'upphandlingsdokumenten' AND tj IN (0, 1, 2) AND td <> doc
  UNION ALL SELECT doc, j, day, position, kind, key, named, 5, 'R2', page, 1, pub, td, NULL, false FROM pg JOIN on_ USING (page) WHERE kind = 'document' AND (key = 'allmänna villkor' AND tj = 7 OR key = 'kravkatalog' AND tj = 8)
  UNION ALL SELECT m.doc, j, day, position, kind, key, named, 1, 'R1x', -1, 1, NULL, m.doc, tp, false FROM m JOIN numbered n ON n.doc = m.doc AND n.number = key WHERE kind = 'section' AND named <> '' AND j = 7
  UNION ALL SELECT pg.doc, j, day, position, kind, key, named, 3, 'R1x', page, 1, pub, td, tp, false FROM pg JOIN on_ USING (page) JOIN numbered n ON n.doc = td AND n.number = key WHERE kind = 'section' AND named <> '' AND j <> 7 AND tj = 7
  UNION ALL SELECT pg.doc, j, day, position, kind, key, named, 5, 'R1q', page, CASE WHEN tj = 1 AND pub <= day THEN 1 ELSE 2 END, pub, td, tp, true FROM pg JOIN on_ USING (page) JOIN numbered n ON n.doc = td AND n.number = key WHERE kind = 'section' AND named = '' AND j = 0 AND tj IN (1, 2)
  UNION ALL SELECT pg.doc, j, day, pg.position, kind, key, named, 6, 'R4q', page, CASE WHEN tj = 1 AND pub <= day THEN 1 ELSE 2 END, pub, td, h.position, true FROM pg JOIN on_ USING (page) JOIN h ON h.doc = td AND h.head = pg.head WHERE j = 0 AND tj IN (1, 2)
  UNION ALL SELECT n.doc, m.j, m.day, n.position, n.kind, n.key, n.named, 7, 'R4', -1, 1, NULL, n.doc, tp, false FROM near3 n JOIN m USING (doc, position, kind, key, named) WHERE n.most = 0 OR n.level = n.low
  UNION ALL SELECT pg.doc, j, day, position, kind, key, named, 8, 'R1a', page, 1, pub, td, tp, false FROM pg JOIN on_ USING (page) JOIN numbered n ON n.doc = td AND n.number = key WHERE kind = 'section' AND named = '' AND j = 3 AND tj IN (4, 5)
  UNION ALL SELECT pg.doc, j, day, pg.position, kind, key, named, 8, 'R4a', page, 1, pub, td, h.position, false FROM pg JOIN on_ USING (page) JOIN h ON h.doc = td AND h.head = pg.head WHERE j = 3 AND tj IN (4, 5)
  UNION ALL SELECT m.doc, j, day, position, kind, key, named, 9, 'R1', -1, 1, NULL, m.doc, tp, false FROM m JOIN numbered n ON n.doc = m.doc AND n.number = key WHERE kind = 'section' AND named = '' AND j <> 0
  UNION ALL SELECT pg.doc, j, day, pg.position, kind, key, named, 10, 'R4p', page, CASE WHEN tj <= 2 THEN 2 ELSE 1 END, pub, td, h.position, tj IN (1, 2) FROM pg JOIN on_ USING (page) JOIN h ON h.doc = td AND h.head = pg.head
  UNION ALL SELECT doc, j, day, position, kind, key, named, CASE WHEN td = doc THEN 0 ELSE 1 END, 'R3', page, 1, pub, td, NULL, false FROM pg JOIN on_ USING (page) WHERE kind = 'annex' AND tj BETWEEN 4 AND 6 AND key = '5.' || CAST(tj - 3 AS VARCHAR)
  UNION ALL SELECT doc, j, day, position, kind, key, named, CASE WHEN td = doc THEN 0 ELSE 1 END, 'R5', page, 1, pub, td, NULL, false FROM pg JOIN on_ USING (page) WHERE kind = 'annex_name' AND tj = 8
  UNION ALL SELECT m.doc, j, day, position, kind, key, named, 1, 'RQ', -1, 1, NULL, m.doc, tp, false FROM m JOIN numbered n ON n.doc = m.doc AND n.number = key WHERE kind = 'question'),
b AS (SELECT * FROM (SELECT *, min(ord) OVER (PARTITION BY doc, position, kind, key, named) AS o FROM c) WHERE ord = o),
k AS (SELECT DISTINCT doc, j, day, position, kind, key, named, rule, page, pub, td, coalesce(tp, -1) AS tp, tender FROM (SELECT *, min(tier) OVER (PARTITION BY doc, position, kind, key, named, page) AS t FROM b) WHERE tier = t),
late AS (SELECT *, max(CASE WHEN pub <= day THEN pub END) OVER (PARTITION BY doc, position, kind, key, named, page) AS newest FROM k),
per AS (SELECT doc, j, position, kind, key, named, rule, page, count(*) AS n, min((td, tp)) AS t, bool_and(tender) AS tender, bool_or(td = doc AND tp = -1) AS self, count(*) FILTER (WHERE pub IS NULL OR pub <= day) AS in_time, min((td, tp)) FILTER (WHERE pub IS NULL OR pub <= day) AS out_t,
  count(*) FILTER (WHERE pub IS NULL) AS undated, count(*) FILTER (WHERE pub = newest) AS last_n, min((td, tp)) FILTER (WHERE pub = newest) AS last_t FROM late GROUP BY ALL),
chosen AS (SELECT *, CASE WHEN in_time = 1 THEN out_t WHEN key <> 'upphandlingsdokumenten' AND undated = 0 AND last_n = 1 THEN last_t END AS day_t FROM per),
o AS (SELECT doc, position, kind, key, named, rule, sum(n) AS targets, min(t) AS t, CASE WHEN bool_or(self) THEN 'self' WHEN max(n) = 1 THEN 'resolved' WHEN j = 0 AND bool_and(tender AND day_t IS NOT NULL) THEN 'resolved' ELSE 'ambiguous' END AS status, max(n) = 1 AS one FROM chosen GROUP BY doc, j, position, kind, key, named, rule),
done AS (SELECT p.doc, p.position, p.kind, p.key, p.named, p.rule, p.page, CASE WHEN one THEN p.t ELSE day_t END AS t FROM chosen p JOIN o ON o.doc = p.doc AND o.position = p.position AND o.kind = p.kind AND o.key = p.key AND o.named = p.named WHERE o.status = 'resolved'),
apart AS (SELECT *, count(*) OVER w AS pages, min(t) OVER w = max(t) OVER w AS agree FROM done WINDOW w AS (PARTITION BY doc, position, kind, key, named)),
r AS (SELECT DISTINCT doc, position, kind, key, named, 'resolved' AS status, rule, CASE WHEN agree THEN 1 ELSE pages END AS targets, CASE WHEN NOT agree THEN page END AS page, t FROM apart
  UNION ALL SELECT doc, position, kind, key, named, status, rule, targets, NULL, t FROM o WHERE status <> 'resolved'
  UNION ALL SELECT doc, position, kind, key, named, CASE kind WHEN 'law' THEN 'external' WHEN 'section' THEN CASE WHEN named <> '' AND NOT EXISTS (SELECT 1 FROM l a JOIN l b ON a.page = b.page AND b.j = 7 WHERE a.doc = m.doc) THEN 'not_published' ELSE 'number_missing' END WHEN 'question' THEN 'number_missing' WHEN 'title' THEN 'title_missing' ELSE 'not_published' END,
    CASE WHEN kind = 'section' AND named <> '' THEN 'R1x' WHEN kind = 'section' AND j = 0 THEN 'R1q' WHEN kind = 'section' THEN 'R1' ELSE MAP {{'title': 'R4', 'annex': 'R3', 'annex_name': 'R5', 'document': 'R2', 'question': 'RQ'}}[kind] END, 0, NULL, NULL
    FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc = m.doc AND o.position = m.position AND o.kind = m.kind AND o.key = m.key AND o.named = m.named))"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Mentions, sections, links and files."""
    s = read(spark, sf_dir, "orders").select(*[F.expr(e) for e in _split(_SECTION)]).withColumn("doc", F.expr("p * 10 + j")).repartition("doc", "position")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(key).alias("key"), F.expr(named).alias("named")) for k, key, named in zip(_KINDS, _KEYS, _GIVEN, strict=True)])
    mentions = s.select("doc", "position", F.explode(each).alias("m")).select("doc", "position", "m.*")
    files = s.select("doc", "p", "j").distinct()
    links = files.select(F.col("p").alias("page"), "doc", F.expr(_TITLE).alias("title"))
    links = links.union(files.filter("j = 7").select((F.col("p") + 1) % 50, "doc", F.expr(_TITLE)))
    published = F.when(F.col("j") == 1, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p") % 25).cast("int"))).when(F.col("j") == 2, F.lit("2024-01-11").cast("date"))
    annex = F.when(F.col("j").between(4, 6), F.concat(F.lit("5."), (F.col("j") - 3).cast("string")))
    return mentions, s, links, files.select("doc", F.expr(_TYPE).alias("document_type"), annex.alias("annex_number"), published.alias("published_on"))


def _split(columns: str) -> list[str]:
    """The expressions of a list, cut at commas outside parentheses."""
    found, depth, word = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            found, word = [*found, word], ""
        else:
            word += ch
    return [*found, word]


@query(f"""WITH {_CASCADE} SELECT doc, position, kind, key, named, status, rule, CAST(targets AS BIGINT) AS targets, coalesce(page, -1) AS page, coalesce(t[1], -1) AS target_doc, coalesce(t[2], -1) AS target_position FROM r""")
def references_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by all rules: logs by the question's day, amendments, pages that agree or don't, the nearest of equal titles."""
    found = cascade.resolve(*_inputs(spark, sf_dir))
    return found.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("page", "target_doc", "target_position")})
