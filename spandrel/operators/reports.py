"""Reports of a build, as tables (section, item, n): what was read, matched, resolved and held back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators.validation import NOTE, QUARANTINE, REPORT

#: Findings from the least to the most severe.
LEVELS = (NOTE, REPORT, QUARANTINE)


def _tally(df: DataFrame, section: str, item: Column, n: Column | None = None) -> DataFrame:
    return df.groupBy(F.coalesce(item.cast("string"), F.lit("none")).alias("item")).agg((F.count("*") if n is None else F.sum(n)).cast("long").alias("n")).select(F.lit(section).alias("section"), "item", "n")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def documents(files: DataFrame) -> DataFrame:
    """Files (sha256, file_type, document_type, type_rule, pages, is_template, needs_ocr, links) by type, kind of file and rule; pages; templates, files to scan and files that no page links to."""
    whole = F.lit("all")
    return _all(
        [
            _tally(files, "document_type", F.col("document_type")),
            _tally(files, "file_type", F.col("file_type")),
            _tally(files, "type_rule", F.concat_ws(" ", "document_type", "type_rule")),
            _tally(files, "pages", whole, F.coalesce("pages", F.lit(0))),
            _tally(files.filter("is_template"), "template", F.col("sha256")),
            _tally(files.filter("needs_ocr"), "needs_ocr", F.col("sha256")),
            _tally(files.filter("links = 0"), "unlinked", F.col("sha256")),
        ]
    )


def outlines(files: DataFrame) -> DataFrame:
    """Files (sections, chunks, outline, toc_gaps): sums, files by kind of outline, and those with gaps in their contents."""
    whole = F.lit("all")
    return _all([_tally(files, "sections", whole, F.col("sections")), _tally(files, "chunks", whole, F.col("chunks")), _tally(files, "outline", F.col("outline")), _tally(files.filter("toc_gaps > 0"), "toc_gaps", whole)])


def register_match(numbers: DataFrame, findings: DataFrame) -> DataFrame:
    """(status, files): files by the worst finding on one of their numbers; `matched` without any.

    numbers: (sha256, subject); findings: (sha256, subject, severity).
    """
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("severity"))
    worst = findings.groupBy("sha256", "subject").agg(F.max(level).alias("level_"))
    per_file = numbers.join(worst, ["sha256", "subject"], "left").groupBy("sha256").agg(F.max(F.coalesce("level_", F.lit(0))).alias("level_"))
    status = F.when(F.col("level_") > 0, F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.greatest(F.col("level_"), F.lit(1)).cast("int"))).otherwise("matched")
    return per_file.groupBy(status.alias("status")).agg(F.count("*").alias("files"))


def area_coverage(agreements: DataFrame) -> DataFrame:
    """Agreements (framework_area, status, has_card, has_main) per area: covered by the card only, the main document only, both; and the other statuses."""
    covered, card, main = F.col("status") == "covered", F.col("has_card"), F.col("has_main")
    return agreements.groupBy("framework_area").agg(
        F.count_if(covered & card & ~main).alias("card_only"),
        F.count_if(covered & ~card & main).alias("main_only"),
        F.count_if(covered & card & main).alias("both"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("procurement_version", "held_back", "not_covered")],
    )


def references(resolved: DataFrame) -> DataFrame:
    """(kind, rule, status, n, share) of references; share is of the kind."""
    tally = resolved.groupBy("kind", F.coalesce("rule", F.lit("none")).alias("rule"), "status").agg(F.count("*").alias("n"))
    of = tally.groupBy("kind").agg(F.sum("n").alias("of_"))
    return tally.join(F.broadcast(of), "kind").select("kind", "rule", "status", "n", F.round(F.col("n") / F.col("of_"), 6).alias("share"))


def findings(found: DataFrame) -> DataFrame:
    """(check, severity, findings, accepted) of findings with accepted_reason."""
    return found.groupBy("check", "severity").agg(F.count("*").alias("findings"), F.count("accepted_reason").alias("accepted"))


def held_back(found: DataFrame) -> DataFrame:
    """(sha256, section_position, reasons): what quarantine holds back, and for what."""
    held = found.filter(f"severity = '{QUARANTINE}' AND accepted_reason IS NULL AND sha256 IS NOT NULL")
    return held.groupBy("sha256", "section_position").agg(F.array_sort(F.collect_set("check")).alias("reasons"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each."""
    return _all([d.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, d in tables.items()])


def index_problems(built: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(field, built, wanted) where an index's manifest (field, value) isn't what search needs; a missing field is null."""
    asked = built.sparkSession.createDataFrame(sorted(wanted.items()), "field string, wanted string")
    return asked.join(built.select("field", F.col("value").alias("built")), "field", "left").filter(~F.col("built").eqNullSafe(F.col("wanted"))).select("field", "built", "wanted")


def not_loaded(register: DataFrame, shown: DataFrame) -> DataFrame:
    """(framework_area, agreements): areas of register (framework_area, agreement_number) none of whose agreements has a file shown, with how many there are."""
    with_file = register.join(shown.select("agreement_number").distinct().withColumn("has_", F.lit(True)), "agreement_number", "left")
    by = with_file.groupBy("framework_area").agg(F.bool_or(F.coalesce("has_", F.lit(False))).alias("any_"), F.count_distinct("agreement_number").alias("agreements"))
    return by.filter("NOT any_").select("framework_area", "agreements")


def answer_problems(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(problems, rejected) of the checks of drafts: (draft, check, problem) of all, and the drafts (draft) that no review has to read, as a rule already rejects them."""
    every = _all([d.select("draft", F.lit(name).alias("check"), F.col("problem").cast("string").alias("problem")) for name, d in parts.items()])
    return every, every.select("draft").distinct()
