"""Party clauses, page furniture, periods and excerpts, over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import dates, text
from spandrel.operators import chunking, parties, references
from spandrel.plans.common import query, read

_FORM = "mellan Staten, organisationsnummer 202100-0829, nedan Kunden, och Firma {k} AB, organisationsnummer {n}, nedan Leverantören"
_OTHER = "mellan Kommun {k}, Org nr: 212000-{t}, (nedan Kommunen), och Firma {k} AB, org.nr FI{n8} nedan kallad \"Leverantören"


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS v, CAST(doc_id AS VARCHAR) AS k, CAST(550000 + doc_id % 9999 AS VARCHAR) AS six, CAST(1000 + doc_id % 9000 AS VARCHAR) AS t, CAST(10000000 + doc_id AS VARCHAR) AS n8 FROM documents),
f AS (SELECT *, CASE v WHEN 0 THEN six || '-' || t || ', med säte i Lund' WHEN 1 THEN six || ' ' || t WHEN 2 THEN '[xxxxxx-yyyy]' WHEN 4 THEN six || '-' || t || '-1' END AS n FROM d WHERE v <> 5)
SELECT doc_id AS doc, CASE v WHEN 1 THEN 3 ELSE 1 END AS position, CASE v WHEN 2 THEN 'placeholder' ELSE 'party' END AS kind, 'E1' AS rule, CASE v WHEN 0 THEN six || '-' || t WHEN 1 THEN six || '-' || t WHEN 2 THEN 'party' WHEN 3 THEN 'FI' || n8 ELSE n END AS value,
  'Firma ' || k || ' AB' AS name, CASE v WHEN 3 THEN 'mellan Kommun ' || k || ', Org nr: 212000-' || t || ', (nedan Kommunen), och Firma ' || k || ' AB, org.nr FI' || n8 || ' nedan kallad "Leverantören'
  ELSE 'mellan Staten, organisationsnummer 202100-0829, nedan Kunden, och Firma ' || k || ' AB, organisationsnummer ' || n || ', nedan Leverantören' END AS raw FROM f
UNION ALL SELECT doc_id, 1, 'party', 'E1-customer', '212000-' || t, 'Kommun ' || k, 'mellan Kommun ' || k || ', Org nr: 212000-' || t || ', (nedan Kommunen), och Firma ' || k || ' AB, org.nr FI' || n8 || ' nedan kallad "Leverantören' FROM f WHERE v = 3""")
def parties_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties of clauses that stand after each text: filled, over two blocks, not filled in, with another customer, mistyped, or none."""
    i, v = F.col("doc_id"), F.col("doc_id") % 6
    six, t = (550000 + i % 9999).cast("string"), (1000 + i % 9000).cast("string")
    number = F.when(v == 0, F.concat(six, F.lit("-"), t, F.lit(", med säte i Lund"))).when(v == 1, F.concat(six, F.lit(" "), t)).when(v == 2, "[xxxxxx-yyyy]").otherwise(F.concat(six, F.lit("-"), t, F.lit("-1")))

    def filled(form: str):
        said = F.lit(form)
        for key, value in (("{k}", i.cast("string")), ("{n8}", (10000000 + i).cast("string")), ("{n}", number), ("{t}", t)):
            said = F.replace(said, F.lit(key), value)
        return said

    clause = F.when(v == 3, filled(_OTHER)).when(v == 5, "avtal mellan parterna, nedan Parterna").otherwise(filled(_FORM))
    cut = F.instr(clause, ", nedan Leverantören") - F.length(number)
    first = F.when(v == 1, F.substring(clause, F.lit(1), cut - 1)).otherwise(clause)
    last = F.when(v == 1, F.substring(clause, cut, F.length(clause))).otherwise("Avtalet gäller.")
    block = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("text"))
    blocks = F.array(block("text", F.col("text")), block("text", first), block("page_footer", F.lit("Sida 1 av 2")), block("text", F.concat(last, F.lit("."))))
    rows = read(spark, sf_dir, "documents").select(i.alias("doc"), F.posexplode(blocks).alias("position", "b")).select("doc", "position", "b.*")
    return parties.find_parties(rows)


@query("""WITH p AS (SELECT doc_id // 8 AS doc, doc_id % 8 AS page, text FROM documents),
b AS (SELECT doc, page, page * 4 AS position, 'Avtal ' || CAST(doc AS VARCHAR) || '  Bilaga' AS text FROM p UNION ALL SELECT doc, page, page * 4 + 1, text FROM p
  UNION ALL SELECT doc, page, page * 4 + 2, 'Utkast' FROM p WHERE page % 4 = doc % 4 UNION ALL SELECT doc, page, page * 4 + 3, 'Sida ' || CAST(page + 1 AS VARCHAR) || ' av 8' FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY position) AS top, row_number() OVER (PARTITION BY doc, page ORDER BY position DESC) AS bottom FROM b),
n AS (SELECT doc, count(DISTINCT page) AS pages FROM b GROUP BY doc),
l AS (SELECT doc, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS line, count(DISTINCT page) AS seen, count(*) AS n, count(*) FILTER (top <= 3 OR bottom <= 3) AS edge FROM o WHERE length(text) <= 150 GROUP BY 1, 2)
SELECT doc, line FROM l JOIN n USING (doc) WHERE pages >= 3 AND seen >= greatest(3, 0.3 * pages) AND edge >= 0.8 * n""")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines that come back at the edges of pages: eight texts are the pages of a document, each with a header and a counter, some with a note."""
    page = F.col("doc_id") % 8
    doc = F.floor(F.col("doc_id") / 8)
    said = F.array(F.concat(F.lit("Avtal "), doc.cast("string"), F.lit("  Bilaga")), F.col("text"), F.when(page % 4 == doc % 4, "Utkast"), F.concat(F.lit("Sida "), (page + 1).cast("string"), F.lit(" av 8")))
    rows = read(spark, sf_dir, "documents").select(doc.alias("doc"), page.alias("page"), F.posexplode(said).alias("at", "text"))
    return chunking.repeated_lines(rows.filter((F.col("at") != 2) | F.col("text").isNotNull()).select("doc", "page", (F.col("page") * 4 + F.col("at")).alias("position"), "text"))


@query("""WITH d AS (SELECT doc_id, CAST(DATE '2019-01-31' + CAST(doc_id % 900 AS INTEGER) AS DATE) AS s, CAST(doc_id % 48 + 1 AS INTEGER) AS m, doc_id % 4 AS v FROM documents)
SELECT doc_id, CASE WHEN v < 3 THEN s END AS starts_on, CASE WHEN v < 3 THEN CAST(s + to_months(m) AS DATE) END AS ends_on, CAST(CAST(s + to_months(m) AS DATE) - 1 AS DATE) AS last FROM d""", dates=("starts_on", "ends_on", "last"))
def periods_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods "date - date" that stand after whole texts, and the last day of so many months."""
    i = F.col("doc_id")
    start, months = F.date_add(F.lit("2019-01-31").cast("date"), (i % 900).cast("int")), (i % 48 + 1).cast("int")
    sign = F.element_at(F.array(F.lit(" – "), F.lit(" till "), F.lit("-"), F.lit(" eller ")), (i % 4 + 1).cast("int"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" Gäller "), start.cast("string"), sign, F.add_months(start, months).cast("string"), F.lit("."))
    found = references.period_in(said)
    return read(spark, sf_dir, "documents").select("doc_id", found["start"].alias("starts_on"), found["end"].alias("ends_on"), dates.last_day_of_period(start, months).alias("last"))


@query("""WITH d AS (SELECT doc_id, text, length(text) // 2 AS s FROM documents WHERE length(text) > 20),
w AS (SELECT *, s + 10 AS e, greatest(s - 45, 0) AS lo, least(s + 10 + 45, length(text)) AS hi FROM d),
p AS (SELECT *, substr(text, lo + 1, hi - lo) AS part FROM w), q AS (SELECT *, CASE WHEN lo > 0 THEN '… ' || regexp_replace(part, '^[^ \\t\\n\\x0b\\f\\r]*[ \\t\\n\\x0b\\f\\r]', '') ELSE part END AS cut FROM p)
SELECT doc_id, CASE WHEN hi < length(text) THEN regexp_replace(cut, '[ \\t\\n\\x0b\\f\\r][^ \\t\\n\\x0b\\f\\r]*$', '') || ' …' ELSE cut END AS excerpt FROM q""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred characters around the middle of each text, cut between words."""
    start = F.floor(F.length("text") / 2).cast("int")
    return read(spark, sf_dir, "documents").filter(F.length("text") > 20).select("doc_id", text.excerpt(F.col("text"), start, start + 10, 100).alias("excerpt"))
