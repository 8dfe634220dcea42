"""Joins over the catalogue of pages, files and the register, and lookups by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions import identifiers

#: Most keys that a lookup sends to every task.
LOOKUP = 100_000


def register_entries(register: dict[str, DataFrame]) -> DataFrame:
    """Every agreement in every sub-area, with the former name of the supplier under its name there, if any."""
    names = register["supplier_name"].select("org_number", F.col("name").alias("supplier_name"), "former_name")
    return register["agreement"].join(register["agreement_sub_area"], "agreement_number").join(names, ["org_number", "supplier_name"], "left")


def catalog_links(links: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """links (page_id, sha256, ...) with what is known of their pages and files."""
    return links.join(pages, "page_id").join(documents, "sha256")


def document_links(catalog: DataFrame, areas: DataFrame, suppliers: DataFrame) -> DataFrame:
    """catalog (procurement_number, agreement_number, ...) with the sorted areas of the procurement, empty if none, and the supplier's name, null if unknown.

    areas: (procurement_number, framework_area); suppliers: (agreement_number, supplier_name), one a number.
    """
    by = areas.groupBy("procurement_number").agg(F.array_sort(F.collect_set("framework_area")).alias("framework_areas"))
    met = catalog.join(by, "procurement_number", "left").join(suppliers, "agreement_number", "left")
    return met.withColumn("framework_areas", F.coalesce("framework_areas", F.array().cast("array<string>")))


def page_scope(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """(page_id, agreement_number): register rows of a page's procurement in a sub-area that has the page's title at any level, whatever the case.

    pages: (page_id, title, procurement_number); rows: (agreement_number, procurement_number, sub_area_path).
    """
    met = pages.select("page_id", "title", "procurement_number").join(rows.select("agreement_number", "procurement_number", "sub_area_path"), "procurement_number")
    return met.filter(F.exists("sub_area_path", lambda x: F.lower(x) == F.lower("title"))).select("page_id", "agreement_number").distinct()


def lookup(table: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows of table whose `by` columns, together, are among the keys; keys are sent to every task if they are few."""
    keys = keys.select(*by).distinct()
    return table.join(F.broadcast(keys) if keys.limit(LOOKUP + 1).count() <= LOOKUP else keys, by, "left_semi")


def procurements_for_areas(rows: DataFrame, areas: list[str]) -> DataFrame:
    """(framework_area, procurement_number) of the areas, whatever the case; KeyError for areas without any."""
    wanted = {a.strip().lower() for a in areas}
    found = rows.filter(F.lower("framework_area").isin(sorted(wanted))).select("framework_area", "procurement_number").distinct()
    missing = wanted - {r[0].lower() for r in found.select("framework_area").distinct().collect()}  # no more than were asked for
    if missing:
        raise KeyError(f"no procurement in {', '.join(sorted(missing))}")
    return found


def document_scopes(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(sha256, framework_areas, procurement_numbers, agreement_numbers, titles): sorted distinct values per file, areas by the procurements of its pages.

    links: (sha256, title, procurement_number, agreement_number); rows: (procurement_number, framework_area).
    """
    areas = rows.select("procurement_number", "framework_area").distinct()
    sets = lambda d, c: d.groupBy("sha256").agg(F.array_sort(F.collect_set(c)).alias(f"{c}s"))
    own = links.groupBy("sha256").agg(*[F.array_sort(F.collect_set(c)).alias(n) for c, n in (("procurement_number", "procurement_numbers"), ("agreement_number", "agreement_numbers"), ("title", "titles"))])
    of = sets(links.select("sha256", "procurement_number").distinct().join(areas, "procurement_number"), "framework_area")
    met = own.join(of, "sha256", "left")
    return met.withColumn("framework_areas", F.coalesce("framework_areas", F.array().cast("array<string>")))


def respell(facts: DataFrame, procurements: DataFrame, agreements: DataFrame) -> DataFrame:
    """facts (value, ...) with spelling: the register's own of the same key, a procurement's before an agreement's; else the value itself."""
    named = procurements.select(F.col("procurement_number").alias("spelling"), identifiers.procurement_key(F.col("procurement_number")).alias("key_"), F.lit(0).alias("order_"))
    named = named.union(agreements.select("agreement_number", identifiers.agreement_key(F.col("agreement_number")), F.lit(1))).filter("key_ IS NOT NULL")
    first = named.groupBy("key_").agg(F.min(F.struct("order_", "spelling")).alias("s_"))
    values = facts.select("value").distinct().withColumn("key_", F.coalesce(identifiers.agreement_key(F.col("value")), identifiers.procurement_key(F.col("value"))))
    known = values.join(first, "key_").select("value", F.col("s_.spelling").alias("spelling"))
    return facts.join(known, "value", "left").withColumn("spelling", F.coalesce("spelling", "value"))


def spellings(register: dict[str, DataFrame], number: str) -> list[str]:
    """Every way in which the register writes an agreement's or procurement's number; of its procurement if the agreement isn't known."""
    wanted = F.lit(number)
    agreement, procurement = F.col("agreement_number"), F.col("procurement_number")
    own = register["agreement"].filter(identifiers.agreement_key(agreement) == identifiers.agreement_key(wanted)).select(agreement.alias("n"))
    whole = register["agreement"].filter(identifiers.procurement_key(procurement) == identifiers.procurement_key(wanted)).select(procurement.alias("n"))
    split = identifiers.split_agreement_number(wanted)["procurement"]
    above = register["agreement"].filter(identifiers.procurement_key(procurement) == identifiers.procurement_key(split)).select(procurement.alias("n"))
    for found in (own, whole, above):
        names = sorted(r[0] for r in found.distinct().collect())  # the spellings of one number
        if names:
            return names
    return []


def gold_sources(alternatives: DataFrame, sections: DataFrame) -> DataFrame:
    """alternatives (question, source_id, sha256, quote) with the one section (sha256, position, text) that holds the quote: position, and found, how many do."""
    met = alternatives.join(sections.select("sha256", "position", "text"), "sha256", "left").withColumn("has_", F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False)))
    by = ["question", "source_id", "sha256", "quote"]
    return met.groupBy(*by).agg(F.count_if("has_").alias("found"), F.min(F.when(F.col("has_"), F.col("position"))).alias("first_")).select(*by, "found", F.when(F.col("found") == 1, F.col("first_")).alias("position"))


def paired_runs(a: DataFrame, b: DataFrame, by: str = "question") -> DataFrame:
    """Two runs' rows of the same question side by side, the second's columns with _b."""
    return a.join(b.select(by, *[F.col(c).alias(f"{c}_b") for c in b.columns if c != by]), by)


def claimed_agreements(drafts: DataFrame) -> DataFrame:
    """drafts (required, declared: arrays of numbers) with hits, misses and extra: how many numbers, by key, are in both, required only, declared only."""
    keys = lambda c: F.array_distinct(F.filter(F.transform(c, identifiers.agreement_key), lambda k: k.isNotNull()))
    r, d = "required_", "declared_"
    keyed = drafts.withColumns({r: keys("required"), d: keys("declared")})
    return keyed.withColumns({"hits": F.size(F.array_intersect(r, d)), "misses": F.size(F.array_except(r, d)), "extra": F.size(F.array_except(d, r))}).drop(r, d)


def removed(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows that are stored and not new."""
    return stored.subtract(new.select(stored.columns))


def rankings(systems: dict[str, DataFrame], key: str = "chunk") -> DataFrame:
    """(system, question, rank, key) of each system's ranking (question, rank, key)."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("system"), "question", F.col("rank").cast("int").alias("rank"), key) for name, d in systems.items()])


def verdict_score(verdict: Column) -> Column:
    """1 for correct, 0.5 for partial, else 0."""
    return F.when(verdict == "correct", 1.0).when(verdict == "partial", 0.5).otherwise(0.0)


def by_agreement(facts: DataFrame) -> DataFrame:
    """(agreement, facts): facts (agreement_number, field, value) by the agreement's key, as sorted field and value pairs."""
    keyed = facts.withColumn("agreement", F.coalesce(identifiers.agreement_key(F.col("agreement_number")), F.col("agreement_number")))
    return keyed.groupBy("agreement").agg(F.array_sort(F.collect_set(F.struct("field", "value"))).alias("facts"))
