"""Types and dates of documents, from links and first blocks made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import doctypes
from spandrel.plans.common import query, read

#: A title, the type and the rule that it leads to.
_TITLES = (
    ("Frågor & svar - Anbudsinbjudan", "questions_and_answers", "R02"), ("Anbudsinbjudan", "procurement_document", "R03"), ("Bilaga 4 Tillägg och förtydliganden", "amendment", "R04"), ("Volymavtal", "main_document", "R05"), ("Bilaga 5.1 Enterprise-avtal", "licence_terms", "R06"),
    ("Allmänna villkor", "general_terms", "R07"), ("Prisbilaga", "price_annex", "R08"), ("Redovisning av hållbarhetskrav", "requirements_report", "R09"), ("Utkast till avtal", "template", "R10"), ("Avropsrutin och Kravkatalog", "annex", "R11b"), ("Snabbguide", "call_off_guidance", "R11"),
    ("Kravkatalog", "requirements_catalogue", "R12"), ("Krav på kompetenser", "requirements_specification", "R13"), ("Bilaga 1 Kontaktuppgifter", "annex", "R14"), ("Något annat", "annex", "F1"),
)
_VALUES = ", ".join(f"({i}, '{t}', '{k}', '{r}')" for i, (t, k, r) in enumerate(_TITLES))
_N = len(_TITLES)


@query(f"""WITH v AS (SELECT * FROM (VALUES {_VALUES}) AS v(i, title, kind, rule)),
l AS (SELECT o_custkey AS sha256, CASE WHEN o_orderkey % 11 = 0 THEN -1 WHEN v.title = 'Något annat' AND o_orderkey % 3 > 0 THEN CASE o_orderkey % 3 WHEN 1 THEN 16 ELSE 99 END WHEN v.title = 'Volymavtal' AND o_orderkey % 2 = 0 THEN 15 ELSE i END AS place FROM orders JOIN v ON i = o_orderkey % {_N}),
b AS (SELECT sha256, min(place) AS place FROM l GROUP BY sha256)
SELECT sha256, CASE place WHEN -1 THEN 'supplier_agreement' WHEN 15 THEN 'annex' WHEN 16 THEN 'procurement_document' WHEN 99 THEN 'unknown' ELSE kind END AS document_type, CASE place WHEN -1 THEN 'R01' WHEN 15 THEN 'F1' WHEN 16 THEN 'F2' WHEN 99 THEN 'none' WHEN 14 THEN 'F1' ELSE rule END AS type_rule FROM b LEFT JOIN v ON i = place""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of files by the earliest rule that any of their links fits: cards, titles, file names and headings."""
    k = F.col("o_orderkey")
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % _N + 1).cast("int"))
    title = at([t for t, _, _ in _TITLES])
    url = F.when((title == "Volymavtal") & (k % 2 == 0), "https://x.se/a/Volymavtal-Bilaga%201.pdf?b=1").otherwise("https://x.se/a/fil.pdf")
    heading = F.when(title != "Något annat", "Avtal").when(k % 3 == 0, "Avtal ").when(k % 3 == 1, "Upphandling")
    links = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha256"), title.alias("title"), url.alias("url"), heading.alias("category"), F.when(k % 11 == 0, "23.3-1-2024-001").alias("agreement_number"))
    return doctypes.classify(links)


_DAY = "CAST(DATE '2024-01-01' + CAST(o_orderkey % 300 AS INTEGER) AS DATE)"


@query(f"""WITH o AS (SELECT o_orderkey AS sha256, o_orderkey % 7 AS v, {_DAY} AS d FROM orders),
r AS (SELECT sha256, v, CASE v WHEN 6 THEN NULL WHEN 2 THEN d + 3 ELSE d END AS version_date, ['template_version', 'template_date', 'tendsign_published', 'tendsign_cover', 'letterhead', 'file_name', ''][v + 1] AS rule, CASE WHEN v = 2 AND sha256 % 2 = 0 THEN NULL WHEN v IN (5, 6) THEN NULL ELSE d END AS published_on FROM o)
SELECT sha256, CAST(CAST(version_date AS DATE) AS VARCHAR) AS version_date, CASE WHEN v = 6 THEN NULL ELSE rule END AS rule, CAST(published_on AS VARCHAR) AS published_on FROM r""")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When documents were last changed and first published, by what their first blocks, headers and file names say."""
    k = F.col("o_orderkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))
    o = read(spark, sf_dir, "orders").select(k.alias("sha256"), (k % 7).alias("v"), day.cast("string").alias("d"), F.date_add(day, 3).cast("string").alias("d3"), F.date_format(day, "yyMMdd").alias("d6"))
    block = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))
    d, v = F.col("d"), F.col("v")
    later = F.when(F.col("sha256") % 2 == 0, "Version 2: p").otherwise("P")
    said = (
        F.when(v == 0, F.array(block("page_header", "Kammarkollegiets version 4.0 (", d, ")"), block("page_header", "Malldatum: 2020-01-01")))
        .when(v == 1, F.array(block("text", "Inledning"), block("page_header", "Mall för Kontrakt | ", d)))
        .when(v == 2, F.array(block("text", "Publicerad ", d, " 10:00"), block("text", later, F.lit("ublicerad "), F.col("d3"), " 12:30")))
        .when(v == 3, F.array(block("text", "Ramavtal"), block("text", d)))
        .when(v == 4, F.array(block("text", "Text"), block("page_header", "Datum Sid 2 (27) ", d, " Dnr 23.5")))
        .otherwise(F.array(block("text", "Ingen dag, 2024-02-31")))
    )
    blocks = o.select("sha256", F.posexplode(said).alias("position", "b")).select("sha256", "position", "b.*")
    links = o.select("sha256", F.when(v == 5, F.concat(F.lit("https://x.se/2_anbud-"), F.col("d6"), F.lit(".pdf"))).otherwise("https://x.se/version-1.02.pdf").alias("url"))
    signed = o.filter("false").select("sha256", F.lit(None).cast("date").alias("day"))
    found = o.select("sha256").join(doctypes.version_dates(blocks, links, signed), "sha256", "left").join(doctypes.published_on(blocks), "sha256", "left")
    return found.withColumns({c: F.col(c).cast("string") for c in ("version_date", "published_on")})
