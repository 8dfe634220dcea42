"""What a document is and from when: types by rules over its links, annex numbers, covers and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import dates

UNKNOWN, NO_RULE = "unknown", "none"
# The rules of types, in the order in which they are tried. Each names what a link has to have: an
# agreement number, a heading that it is listed under, a title or a file name that matches (one is enough), and what
# the file name may not have.
RULES: tuple[dict[str, str], ...] = (
    {"rule": "R01", "type": "supplier_agreement", "card": "yes"},
    {"rule": "R02", "type": "questions_and_answers", "title": r"fr[åa]gor\s*(?:och|&|-)\s*svar"},
    {"rule": "R03", "type": "procurement_document", "title": r"upphandlingsdokument|ansökningsinbjudan|anbudsinbjudan|kvalificering av sökande"},
    {"rule": "R04", "type": "amendment", "title": r"tilläggsavtal|tillägg och förtydligande|ändring", "file": r"tillaggsavtal"},
    {"rule": "R05", "type": "main_document", "title": r"^(?:ramavtalets huvuddokument|volymavtalets huvudavtal|ibm volymavtal|volymavtal)\b", "file_not": r"bilaga"},
    {"rule": "R06", "type": "licence_terms", "title": r"business and services agreement|enterprise|select plus|campus|enrollment|produktvillkor|product terms|dataskyddstill|data processing|passport advantage|\bIPLA\b|academic|molntj|användningsvillkor|arbetsorder|registrering|attachment"},
    {"rule": "R07", "type": "general_terms", "title": r"^allmänna villkor\b"},
    {"rule": "R08", "type": "price_annex", "title": r"pris"},
    {"rule": "R09", "type": "requirements_report", "title": r"^redovisning av"},
    {"rule": "R10", "type": "template", "title": r"^utkast till|avropsmall|kontraktsmall|avropsblankett"},
    {"rule": "R11b", "type": "annex", "title": r"^avropsrutin"},
    {"rule": "R11", "type": "call_off_guidance", "title": r"vägledning|snabbguide|checklista|tips|byte av konsult|avbokningsmatris|uppföljning|exempelroller"},
    {"rule": "R12", "type": "requirements_catalogue", "title": r"kravkatalog"},
    {"rule": "R13", "type": "requirements_specification", "title": r"kravspecifikation|krav på kompetenser"},
    {"rule": "R14", "type": "annex", "title": r"^bilaga\b"},
    {"rule": "F1", "type": "annex", "category": "Avtal"},
    {"rule": "F2", "type": "procurement_document", "category": "Upphandling"},
    {"rule": "F3", "type": "call_off_guidance", "category": "Stöddokument och länkar"},
)
# The groups of types that aren't the agreement's.
GROUPS = {"procurement": ("procurement_document", "questions_and_answers"), "support": ("call_off_guidance", "requirements_report", "template")}
# Forms of covers, template versions, publication stamps and letterheads.
_DATE = r"((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])"
COVERS = "Upphandlingsdokument|Ramavtal|Inbjudan"
TEMPLATE_VERSION = rf"Kammarkollegiets version [0-9]+(?:\.[0-9]+)* \({_DATE}\)"
TEMPLATE_DATE = rf"(?:Malldatum:\s*|^Mall för [^|]+\|\s*){_DATE}"
PUBLISHED = rf"(?:Version ([0-9]+): )?[Pp]ublicerad {_DATE} [0-9]{{2}}:[0-9]{{2}}"
LETTERHEAD = rf"^(?:Datum\s+(?:Sid\s+[0-9]+\s*\([0-9]+\)\s+)?)?{_DATE}(?:\s+(?:Dnr|Sid)\b|$)"
FILE_DATES = ((r"(?<![0-9])(20[0-9]{2})-([0-9]{2})-([0-9]{2})(?![0-9])", ""), (r"(?<![0-9])(20[0-9]{2})([0-9]{2})([0-9]{2})(?![0-9])", ""), (r"(?<![0-9.])([0-9]{2})([0-9]{2})([0-9]{2})(?![0-9.])", "20"))
COVER_BLOCKS, FIRST_BLOCKS = 6, 40


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def file_name(url: Column) -> Column:
    """The last part of a URL's path, decoded, in lower case; a part that can't be decoded stays as it is."""
    last = F.regexp_extract(F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1), r"([^/]*)$", 1)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _holds(rule: dict[str, str]) -> Column:
    """Whether a link (title, file, category, agreement_number) fits a rule; nulls fit nothing."""
    has = lambda c, form: F.coalesce(F.col(c).rlike(f"(?iu){form}"), F.lit(False))
    fits = F.lit(True)
    if "card" in rule:
        fits &= F.coalesce(F.col("agreement_number"), F.lit("")) != ""
    if "category" in rule:
        fits &= F.trim(F.coalesce("category", F.lit(""))) == rule["category"]
    if "file_not" in rule:
        fits &= ~has("file", rule["file_not"])
    either = [has(c, rule[c]) for c in ("title", "file") if c in rule]
    return fits & reduce(Column.__or__, either) if either else fits


def classify(links: DataFrame) -> DataFrame:
    """(sha256, document_type, type_rule) from links (sha256, title, url, category, agreement_number): the earliest rule that any of a file's links fits, else UNKNOWN."""
    named = links.select("sha256", one_line(F.col("title")).alias("title"), file_name(F.col("url")).alias("file"), "category", "agreement_number")
    place = F.coalesce(*[F.when(_holds(r), i) for i, r in enumerate(RULES)], F.lit(len(RULES)))
    best = named.groupBy("sha256").agg(F.min(place).alias("i"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("i") + 1)
    return best.select("sha256", pick([*[r["type"] for r in RULES], UNKNOWN]).alias("document_type"), pick([*[r["rule"] for r in RULES], NO_RULE]).alias("type_rule"))


def group_of(document_type: Column) -> Column:
    return F.when(document_type.isin(*GROUPS["procurement"]), "procurement").when(document_type.isin(*GROUPS["support"]), "support").when(document_type != UNKNOWN, "agreement")


def annex_numbers(links: DataFrame) -> DataFrame:
    """(sha256, annex_number) of files whose link titles give one, or else their file names; of several the smallest as text."""
    found = lambda c, form: F.nullif(F.regexp_extract(c, form, 1), F.lit(""))
    title = found(one_line(F.col("title")), r"(?iu)^Bilaga ([0-9]+(?:\.[0-9]+)?)")
    name = found(_stem(file_name(F.col("url"))), r"bilaga-([0-9]+(?:\.[0-9]+)?)")
    per = links.groupBy("sha256").agg(F.min(title).alias("a"), F.min(name).alias("b"))
    return per.select("sha256", F.coalesce("a", "b").alias("annex_number")).filter("annex_number IS NOT NULL")


def first_chapters(sections: DataFrame) -> DataFrame:
    """(doc, chapter) of numbered outlines (doc, position, number) that start at another chapter than 1: parts of a larger document."""
    first = sections.filter("number IS NOT NULL AND number <> ''").groupBy("doc").agg(F.min_by("number", "position").alias("number"))
    return first.select("doc", F.substring_index("number", ".", 1).try_cast("int").alias("chapter")).filter("chapter <> 1")


def covers(blocks: DataFrame) -> DataFrame:
    """(sha256, cover, day) of printouts: a cover's word with a date, or before a block that is a date alone, among the first blocks (sha256, position, text)."""
    order = Window.partitionBy("sha256").orderBy("position")
    first = blocks.select("sha256", "position", one_line(F.col("text")).alias("line")).withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= COVER_BLOCKS)
    first = first.withColumn("next_", F.lead("line").over(order))
    together = dates.iso_date(F.regexp_extract("line", rf"^(?:{COVERS}) {_DATE}$", 1))
    apart = F.when(F.col("line").rlike(f"^(?:{COVERS})$"), dates.iso_date(F.regexp_extract("next_", rf"^{_DATE}$", 1)))
    met = first.select("sha256", "n_", F.regexp_extract("line", f"^({COVERS})", 1).alias("cover"), F.coalesce(together, apart).alias("day")).filter("day IS NOT NULL")
    return met.groupBy("sha256").agg(F.min_by(F.struct("cover", "day"), "n_").alias("x")).select("sha256", "x.*")


def _stamps(blocks: DataFrame) -> DataFrame:
    """(sha256, version, day) of every publication stamp."""
    found = blocks.select("sha256", F.explode(F.regexp_extract_all(one_line(F.col("text")), F.lit(PUBLISHED), F.lit(0))).alias("raw"))
    version = F.nullif(F.regexp_extract("raw", PUBLISHED, 1), F.lit("")).try_cast("int")
    return found.select("sha256", F.coalesce(version, F.lit(1)).alias("version"), dates.iso_date(F.regexp_extract("raw", PUBLISHED, 2)).alias("day")).filter("day IS NOT NULL")


def version_dates(blocks: DataFrame, links: DataFrame, signed: DataFrame) -> DataFrame:
    """(sha256, version_date, rule): when a document was last changed, by the first source that says so.

    blocks: (sha256, position, kind, text); links: (sha256, url); signed: (sha256,
    day). In order: a template's version or date, the latest publication stamp,
    the cover, the letterhead of a page header, the last signature, and the latest
    date in a file name. Dates that the calendar doesn't have count for nothing.
    """
    lines = blocks.select("sha256", "position", "kind", one_line(F.col("text")).alias("line"))
    day = lambda form: dates.iso_date(F.regexp_extract("line", form, 1))
    first = lambda d: F.min_by(d, F.when(d.isNotNull(), F.col("position")))
    of_blocks = lines.groupBy("sha256").agg(first(day(TEMPLATE_VERSION)).alias("template_version"), first(day(TEMPLATE_DATE)).alias("template_date"), first(F.when(F.col("kind") == "page_header", day(LETTERHEAD))).alias("letterhead"))
    names = links.select("sha256", _stem(file_name(F.col("url"))).alias("name")).distinct()

    def in_names(form: str, century: str) -> Column:
        return F.transform(F.regexp_extract_all("name", F.lit(form), F.lit(0)), lambda raw: dates.iso_date(F.regexp_replace(raw, form, f"{century}$1-$2-$3")))

    parts = {
        "template_version": of_blocks.select("sha256", F.col("template_version").alias("day")),
        "template_date": of_blocks.select("sha256", F.col("template_date").alias("day")),
        "tendsign_published": _stamps(blocks).select("sha256", "day"),
        "tendsign_cover": covers(blocks).select("sha256", "day"),
        "letterhead": of_blocks.select("sha256", F.col("letterhead").alias("day")),
        "signed": signed.select("sha256", "day"),
        "file_name": names.select("sha256", F.explode(F.concat(*[in_names(*f) for f in FILE_DATES])).alias("day")),
    }
    every = reduce(DataFrame.unionByName, [d.select("sha256", F.lit(i).alias("order"), F.lit(rule).alias("rule"), "day") for i, (rule, d) in enumerate(parts.items())])
    best = every.filter("day IS NOT NULL").groupBy("sha256", "order", "rule").agg(F.max("day").alias("version_date"))
    return best.groupBy("sha256").agg(F.min_by(F.struct("version_date", "rule"), "order").alias("x")).select("sha256", "x.*")


def published_on(blocks: DataFrame) -> DataFrame:
    """(sha256, published_on): the first publication stamp, or else the first date among the first blocks; nothing for a document that says it is a later version."""
    stamps = _stamps(blocks).groupBy("sha256").agg(F.min("day").alias("day"), F.max("version").alias("version"))
    order = Window.partitionBy("sha256").orderBy("position")
    first = blocks.withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= FIRST_BLOCKS)
    found = F.filter(F.transform(F.regexp_extract_all(one_line(F.col("text")), F.lit(rf"(?<![0-9]){_DATE}"), F.lit(1)), lambda d: dates.iso_date(d)), lambda d: d.isNotNull())
    early = first.select("sha256", "n_", F.try_element_at(found, F.lit(1)).alias("early")).filter("early IS NOT NULL").groupBy("sha256").agg(F.min_by("early", "n_").alias("early"))
    met = stamps.join(early, "sha256", "full")
    day = F.when(F.col("version") > 1, F.lit(None).cast("date")).otherwise(F.coalesce("day", "early"))
    return met.select("sha256", day.alias("published_on")).filter("published_on IS NOT NULL")
