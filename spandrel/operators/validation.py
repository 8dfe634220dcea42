"""Checks of documents against the register, the quarantine they lead to, and checks of answers.

A check gives findings (check, severity, subject, sha256, section_position). What
is in quarantine, and what was never checked, is held back: visibility is what is
indexed, less both.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spandrel.functions import dates, identifiers, text

QUARANTINE, REPORT, NOTE = "quarantine", "report", "note"


def finding(check: str, severity: str | Column, subject: Column, section: Column | None = None) -> list[Column]:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return [F.lit(check).alias("check"), level.alias("severity"), subject.cast("string").alias("subject"), F.col("sha256"), (section if section is not None else F.lit(None)).cast("long").alias("section_position")]


def _keyed(rows: DataFrame, column: str, key: Callable[[Column], Column]) -> DataFrame:
    """rows with key, parsed once for each distinct value of the column: far fewer than there are rows."""
    return rows.join(rows.select(column).distinct().withColumn("key", key(F.col(column))), column, "left")


def procurement_number(facts: DataFrame, page_numbers: DataFrame) -> DataFrame:
    """Own numbers that no page of the file has are held back; cited ones are noted.

    facts: (sha256, value, role, case_management, known); page_numbers: (sha256, procurement_number).
    """
    keys = _keyed(page_numbers, "procurement_number", identifiers.procurement_key).select("sha256", "key").distinct()
    read = _keyed(facts, "value", identifiers.procurement_key).filter("key IS NOT NULL AND (NOT case_management OR known)")
    return read.join(keys, ["sha256", "key"], "left_anti").select(*finding("procurement_number", F.when(F.col("role") == "self", QUARANTINE).otherwise(NOTE), F.col("key"))).distinct()


def agreement_number(facts: DataFrame, cards: DataFrame) -> DataFrame:
    """A supplier's document that states another agreement than its card's, and any other document that states one as its own."""
    own = _keyed(facts.filter("role = 'self'"), "value", identifiers.agreement_key)
    card = _keyed(cards, "agreement_number", identifiers.agreement_key).select("sha256", F.col("key").alias("card_key"))
    return own.join(card, "sha256", "left").filter("card_key IS NULL OR key <> card_key").select(*finding("agreement_number", QUARANTINE, F.col("key"))).distinct()


#: Stated numbers that one task compares.
NUMBERS = 500_000


def org_numbers(facts: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Organisation numbers (sha256, value) that aren't among the file's suppliers (sha256, org_number)."""
    both = facts.select("sha256", "value", F.lit(False).alias("known_")).union(suppliers.select("sha256", "org_number", F.lit(True)))
    parts = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-facts.count() // NUMBERS))
    met = both.repartition(parts, "sha256", "value").groupBy("sha256", "value").agg(F.bool_or("known_").alias("known_"), F.bool_and("known_").alias("only_"))
    # Nulls are no supplier's.
    return met.filter(~F.col("only_") & ~(F.col("known_") & F.col("sha256").isNotNull() & F.col("value").isNotNull())).select(*finding("org_numbers", QUARANTINE, F.col("value")))


def supplier_party(parties: DataFrame, register: DataFrame) -> DataFrame:
    """A party's number differs or isn't filled in: held back; its name alone differs: noted.

    parties: (sha256, agreement_number, org_number, name); register: (agreement_number, org_number, supplier_name).
    """
    both = parties.alias("p").join(register.alias("r"), "agreement_number")
    differs = F.col("p.org_number").isNull() | (F.col("p.org_number") != F.col("r.org_number"))
    renamed = text.company_form(F.col("p.name")) != text.company_form(F.col("r.supplier_name"))
    return both.filter(differs | renamed).select(*finding("supplier_party", F.when(differs, QUARANTINE).otherwise(NOTE), F.coalesce("p.org_number", "p.name")))


def document_type(metadata: DataFrame) -> DataFrame:
    """Unknown types are reported, types by a fallback rule noted."""
    odd = metadata.filter("document_type = 'unknown' OR type_rule LIKE 'F%'")
    return odd.select(*finding("document_type", F.when(F.col("document_type") == "unknown", REPORT).otherwise(NOTE), F.col("type_rule")))


def missing_text(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections that scanned pages (sha256, number, needs_ocr) lie in, or lie between them and the next section with a page."""
    w = Window.partitionBy("sha256").orderBy("position").rowsBetween(1, Window.unboundedFollowing)
    placed = sections.withColumn("next_start", F.first("page_start", ignorenulls=True).over(w))
    scanned = pages.filter("needs_ocr").select("sha256", F.col("number").alias("page"))
    inside = F.col("page").between(F.col("page_start"), F.col("page_end")) | ((F.col("page") > F.col("page_end")) & (F.col("page") < F.col("next_start")))
    return placed.join(scanned, "sha256").filter(inside).select(*finding("missing_text", QUARANTINE, F.col("page"), F.col("position"))).distinct()


def still_published(links: DataFrame) -> DataFrame:
    """Files all of whose pages (sha256, missing_since) are gone."""
    gone = links.groupBy("sha256").agg(F.bool_and(F.col("missing_since").isNotNull()).alias("gone"), F.max("missing_since").alias("since")).filter("gone")
    return gone.select(*finding("still_published", QUARANTINE, F.col("since")))


def coverage(agreements: DataFrame, files: DataFrame) -> DataFrame:
    """agreements with status: covered, procurement_version, held_back or not_covered, the best of their files' reasons.

    files: (agreement_number, sha256, reason), reason null for a file that counts, else quarantined, tendsign_printout or template.
    """
    seen = files.groupBy("agreement_number").agg(
        F.bool_or(F.col("reason").isNull()).alias("counts"), F.bool_or(F.col("reason").isNotNull() & (F.col("reason") != "quarantined")).alias("version"), F.count("*").alias("files")
    )
    status = F.when(F.col("counts"), "covered").when(F.col("version"), "procurement_version").when(F.col("files") > 0, "held_back").otherwise("not_covered")
    return agreements.join(seen, "agreement_number", "left").withColumn("status", status).drop("counts", "version", "files")


def accept(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """findings with accepted_reason, from (key, reason): the key is check:sha256:subject."""
    key = F.concat_ws(":", "check", F.substring("sha256", 1, 12), "subject")
    return findings.withColumn("key", key).join(accepted, "key", "left").withColumnRenamed("reason", "accepted_reason")


def quarantine(findings: DataFrame) -> DataFrame:
    """(sha256, section_position) held back: null for a whole file. Accepted findings hold nothing back."""
    return findings.filter(f"severity = '{QUARANTINE}' AND accepted_reason IS NULL AND sha256 IS NOT NULL").select("sha256", "section_position").distinct()


def visible(indexed: DataFrame, checked: DataFrame, held: DataFrame) -> DataFrame:
    """The sections (sha256, section_position, ...) that are checked and held back neither by file nor by section."""
    files = held.filter("section_position IS NULL").select("sha256")
    sections = held.filter("section_position IS NOT NULL").select("sha256", "section_position")
    return indexed.join(checked.select("sha256").distinct(), "sha256", "left_semi").join(files, "sha256", "left_anti").join(sections, ["sha256", "section_position"], "left_anti")


# Answers

MIN_QUOTE = 15


def citations(drafts: DataFrame, sections: DataFrame) -> DataFrame:
    """(draft, id, problem) for quotes that are missing, too short or not in their section.

    drafts: (draft, id, sha256, section_position, quote); sections: (sha256, section_position, text).
    """
    said = text.quote_form(text.trim_quote(F.col("quote")), compose=True)
    whole = text.quote_form(F.col("text"), compose=True)
    met = drafts.join(sections, ["sha256", "section_position"], "left")

    def problem(forms: Column) -> Column:
        said, whole = forms["said"], forms["whole"]
        return F.when(whole.isNull(), "no_section").when(~whole.contains(said), "not_verbatim").when((F.length(said) < MIN_QUOTE) & (said != whole), "too_short")

    # A function of one argument holds the forms, and a list the problem, so that a text is read once.
    forms = F.array(F.struct(said.alias("said"), whole.alias("whole")))
    return met.select("draft", "id", F.explode(F.array_compact(F.transform(forms, problem))).alias("problem"))


def marker_problems(drafts: DataFrame) -> DataFrame:
    """(draft, problem) from drafts (draft, text, ids): undefined, unused, duplicate and non-contiguous source numbers."""
    used, own = text.markers(F.col("text")), F.array_distinct("ids")
    rules = {
        "undefined": F.size(F.array_except(used, own)) > 0,
        "unused": F.size(F.array_except(own, used)) > 0,
        "duplicate": F.size(own) < F.size("ids"),
        "gap": F.when(F.size(own) > 0, F.array_sort(own) != F.sequence(F.lit(1), F.size(own))).otherwise(False),
    }
    return drafts.select("draft", F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in rules.items()]), lambda x: x.isNotNull())).alias("problem"))


def latest_wording(cited: DataFrame, amendments: DataFrame) -> DataFrame:
    """Cited sections (draft, sha256, section_position) with an amendment of which the draft cites none.

    amendments: (target_sha256, target_section_position, sha256, section_position); a null target position is the whole file.
    """
    cited = cited.select("draft", "sha256", "section_position").distinct()
    c = cited.toDF("draft", "of_sha256", "of_position")
    # However often a section was amended by the same one, drafts meet it once.
    a = amendments.select(F.col("target_sha256").alias("of_sha256"), F.col("target_section_position").alias("of_position"), "sha256", "section_position").distinct()
    due = c.join(a.filter("of_position IS NULL").drop("of_position"), "of_sha256").unionByName(c.join(a.filter("of_position IS NOT NULL"), ["of_sha256", "of_position"]))
    met = due.join(cited.withColumn("done_", F.lit(True)), ["draft", "sha256", "section_position"], "left")
    open_ = met.groupBy("draft", "of_sha256", "of_position").agg(F.count("done_").alias("done_")).filter("done_ = 0")
    return open_.select("draft", F.col("of_sha256").alias("sha256"), F.col("of_position").alias("section_position"))


def line_coverage(lines: DataFrame, sections: DataFrame, least: int = 25) -> DataFrame:
    """lines (doc, line) of at least so many letters and digits, with found: whether the document's section text (doc, text) holds them."""
    form = text.letters_and_digits(F.col("line"))
    whole = sections.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: text.letters_and_digits(x["text"])), "\n").alias("whole"))
    return lines.withColumn("form", form).filter(F.length("form") >= least).join(whole, "doc", "left").select("doc", "line", F.coalesce(F.col("whole").contains(F.col("form")), F.lit(False)).alias("found"))


#: Characters by which quotes without whole words meet texts.
CHARACTERS = 3


def quoted(texts: DataFrame, quotes: DataFrame, gram: int = 5) -> DataFrame:
    """(doc, quote_id): the texts (doc, text) that hold a quote (quote_id, quote) word for word, both in quote_form.

    Words of a quote but its first and last, which may be parts of words, are
    looked up in all texts by the first `gram` of them, or as many as there are;
    what is found is compared whole. Quotes of one or two words meet texts by
    their first characters. Texts give such probes only of lengths that some quote
    asks for. Nulls and empty quotes are found nowhere.
    """
    form = lambda c: text.quote_form(F.col(c))
    q = quotes.filter("quote IS NOT NULL").select("quote_id", form("quote").alias("said")).filter("said <> ''").withColumn("w", F.split("said", " "))
    n = F.least(F.size("w") - 2, F.lit(gram))
    by_words = F.struct(F.lit(True).alias("words"), n.alias("n"), F.xxhash64(F.slice("w", F.lit(2), F.greatest(n, F.lit(0)))).alias("h"))
    length = F.least(F.length("said"), F.lit(CHARACTERS))
    by_characters = F.struct(F.lit(False).alias("words"), length.alias("n"), F.xxhash64(F.slice(F.split("said", ""), F.lit(1), length)).alias("h"))
    q = q.select("quote_id", "said", F.when(n > 0, by_words).otherwise(by_characters).alias("p")).select("quote_id", "said", "p.*")
    t = texts.filter("text IS NOT NULL").select("doc", form("text").alias("whole"))

    def probes(whole_words: bool, k: int) -> Column:
        """The hashes of all runs of k words or characters. A function of one argument holds the parts, so that a text is split once."""
        parts = F.array(F.split("whole", " " if whole_words else ""))
        places = lambda w: F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(parts, lambda w: F.transform(places(w), lambda i: F.xxhash64(F.slice(w, i, F.lit(k)))))[0]

    near = [
        t.select("doc", F.explode(F.array_distinct(probes(r["words"], r["n"]))).alias("h")).join(q.filter((F.col("words") == r["words"]) & (F.col("n") == r["n"])).select("quote_id", "h"), "h").select("doc", "quote_id").distinct()
        for r in q.select("words", "n").distinct().collect()  # as many as there are lengths: gram and CHARACTERS at most
    ]
    if not near:
        return t.sparkSession.createDataFrame([], StructType([t.schema["doc"], q.schema["quote_id"]]))
    met = reduce(DataFrame.unionByName, near).join(q.select("quote_id", "said"), "quote_id").join(t, "doc")
    return met.filter(F.col("whole").contains(F.col("said"))).select("doc", "quote_id").distinct()


def near_misses(stated: DataFrame, register: DataFrame) -> DataFrame:
    """stated (draft, agreement_number, day) a day off a date of the agreement's (agreement_number, valid_from, valid_to, max_extension_to), and none of them."""
    days = F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("valid_from", "valid_to", "max_extension_to")))))
    known = register.join(stated.select("agreement_number").distinct(), "agreement_number", "left_semi").groupBy("agreement_number").agg(days.alias("days_"))
    met = stated.join(known, "agreement_number")
    off = F.exists("days_", lambda d: F.abs(F.datediff(d, "day")) == 1)
    return met.filter(off & ~F.array_contains("days_", F.col("day"))).select(*stated.columns)


def register_facts(stated: DataFrame, register: DataFrame) -> DataFrame:
    """(draft, statement, problem): agreements, organisations and dates that a statement gives and no register row backs for what else it names.

    stated: (draft, statement, kind, value) of kinds agreement, organisation and
    date, numbers as keys and dates in ISO form; register: (agreement_key,
    org_number, valid_from, valid_to, max_extension_to). A date or organisation
    has to be of an agreement that its own statement names; without one, of any
    agreement of the draft; without any, of the whole register.
    """
    days = F.array_compact(F.array(*[F.col(c).cast("string") for c in ("valid_from", "valid_to", "max_extension_to")]))
    values = register.select("agreement_key", F.explode(F.concat(F.array(F.struct(F.lit("organisation").alias("kind"), F.col("org_number").alias("value"))), F.transform(days, lambda d: F.struct(F.lit("date").alias("kind"), d.alias("value"))))).alias("x")).select("agreement_key", "x.kind", "x.value").distinct()
    own = stated.filter("kind = 'agreement'").select("draft", "statement", F.col("value").alias("agreement_key")).distinct()
    unknown = own.join(register.select("agreement_key").distinct(), "agreement_key", "left_anti").select("draft", "statement", F.concat(F.lit("agreement "), "agreement_key").alias("problem"))
    facts = stated.filter("kind <> 'agreement'").select("draft", "statement", "kind", "value").distinct()
    scope = facts.join(own.select("draft", "statement").distinct().withColumn("near_", F.lit(True)), ["draft", "statement"], "left").join(own.select("draft").distinct().withColumn("far_", F.lit(True)), "draft", "left")
    backed = own.join(values, "agreement_key")
    near = scope.filter("near_").join(backed.select("draft", "statement", "kind", "value").distinct(), ["draft", "statement", "kind", "value"], "left_anti")
    far = scope.filter("near_ IS NULL AND far_").join(backed.select("draft", "kind", "value").distinct(), ["draft", "kind", "value"], "left_anti")
    anywhere = scope.filter("near_ IS NULL AND far_ IS NULL").join(values.select("kind", "value").distinct(), ["kind", "value"], "left_anti")
    found = [d.select("draft", "statement", F.concat_ws(" ", "kind", "value").alias("problem")) for d in (near, far, anywhere)]
    return unknown.union(found[0]).union(found[1]).union(found[2])


def stated_periods(facts: DataFrame) -> DataFrame:
    """(sha256, statement, scope, starts, ends, extension_months) from facts (sha256, statement, kind, day, months, scope) of kinds start, end, length and extension.

    An end that isn't stated is a length from a start. The extension is the
    longest of the statement, else of the file. Statements without start and end
    are left out, and facts without a statement are no period's.
    """
    days = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("day"))))
    longest = F.max(F.when(F.col("kind") == "extension", F.col("months")))
    lengths = F.collect_set(F.when(F.col("kind") == "length", F.col("months")))
    per = facts.filter("statement IS NOT NULL").groupBy("sha256", "statement").agg(F.min("scope").alias("scope"), days("start").alias("starts"), days("end").alias("stated"), lengths.alias("lengths"), longest.alias("own"))
    after = F.flatten(F.transform("starts", lambda s: F.transform("lengths", lambda m: dates.last_day_of_period(s, m))))
    ends = F.when(F.size("stated") > 0, F.col("stated")).otherwise(F.array_sort(F.array_distinct(after)))
    whole = facts.groupBy("sha256").agg(longest.alias("any"))
    return per.join(whole, "sha256").select("sha256", "statement", "scope", "starts", ends.alias("ends"), F.coalesce("own", "any").alias("extension_months")).filter("size(starts) + size(ends) > 0")


def _one_period(entries: DataFrame, *by: str) -> DataFrame:
    return entries.groupBy(*by).agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), F.max("max_extension_to").alias("max_extension_to"))


def compared_periods(statements: DataFrame, cards: DataFrame, agreements: DataFrame, links: DataFrame, areas: DataFrame) -> DataFrame:
    """statements with what they are compared with: subject, valid_from, valid_to, max_extension_to.

    cards: (sha256, agreement_number); agreements: (agreement_number, valid_from,
    valid_to, max_extension_to), any spelling. A supplier's card is compared with
    its own agreements. Any other file is compared with the areas (page,
    valid_from, ...) of its pages, by links (sha256, page, page_title): those whose
    title has the statement's scope, or is within it, if there is a scope; and only
    if all of them have one period. A scope that begins with a number and a full
    stop names the area of that number.
    """
    numbers = cards.select("agreement_number").union(agreements.select("agreement_number")).filter("agreement_number IS NOT NULL").distinct()
    keys = numbers.withColumn("key", F.coalesce(identifiers.agreement_key(F.col("agreement_number")), F.col("agreement_number").cast("string")))
    own = cards.filter("agreement_number IS NOT NULL").join(keys, "agreement_number").select("sha256", "key").distinct()
    known = _one_period(agreements.join(keys, "agreement_number"), "key")
    of_cards = statements.join(own.join(known, "key").withColumnRenamed("key", "subject"), "sha256")

    pages = links.groupBy("sha256", "page").agg(F.min("page_title").alias("page_title"))
    number, title, scope = F.regexp_extract("scope", r"^\s*([0-9]+)\.", 1), F.lower("page_title"), F.lower("scope")
    numbered = F.regexp_like("page_title", F.concat(F.lit(r"(?<![0-9.])"), number, F.lit(r"\.(?![0-9])")))
    fits = F.col("scope").isNull() | F.when(number != "", numbered).otherwise(F.contains(title, scope) | F.contains(scope, title))
    others = statements.join(own.select("sha256").distinct(), "sha256", "left_anti").join(pages, "sha256").filter(fits)
    per_page = others.join(_one_period(areas, "page"), "page")
    key = ["sha256", "statement"]
    one = per_page.groupBy(*key).agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), F.max("max_extension_to").alias("max_extension_to"), F.min(F.struct("valid_from", "valid_to")).alias("a"), F.max(F.struct("valid_from", "valid_to")).alias("b"), F.count("*").alias("n"), F.min("page_title").alias("title"))
    subject = F.when(F.col("n") == 1, F.col("title")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" pages")))
    of_pages = statements.join(one.filter(F.col("a") == F.col("b")).select(*key, subject.alias("subject"), "valid_from", "valid_to", "max_extension_to"), key)
    return of_cards.unionByName(of_pages)


def period_outcome(starts: Column, ends: Column, extension_months: Column, valid_from: Column, valid_to: Column, max_extension_to: Column) -> Column:
    """MATCH, EXTENSION_USED, LATER_START or DEVIATES: a statement's starts and ends against a period of the register.

    A start after the register's deviates, and so does an end that isn't the
    register's and can't be extended to it; a start before it means that the
    agreement began later than planned.
    """
    outcomes = F.transform(ends, lambda e: dates.end_outcome(e, extension_months, valid_to, max_extension_to))
    deviates = F.exists(starts, lambda s: s > valid_from) | F.array_contains(outcomes, "DEVIATES")
    return F.when(deviates, "DEVIATES").when(F.exists(starts, lambda s: s < valid_from), "LATER_START").when(F.array_contains(outcomes, "EXTENSION_USED"), "EXTENSION_USED").otherwise("MATCH")


def agreement_period(compared: DataFrame) -> DataFrame:
    """Findings where a file's stated period isn't the register's: held back; noted at the stage of procurement and where the agreement began later; reported where a page, not a document, says so.

    compared: what compared_periods() gives, with stage and source. Templates have
    no period of their own: leave them out. A null start, end or register date
    compares with nothing.
    """
    outcome = period_outcome(F.col("starts"), F.col("ends"), F.col("extension_months"), F.col("valid_from"), F.col("valid_to"), F.col("max_extension_to"))
    found = compared.withColumn("outcome", outcome).filter("outcome IN ('DEVIATES', 'LATER_START')")
    severity = F.when((F.col("outcome") == "LATER_START") | F.col("stage").eqNullSafe("procurement"), NOTE).when(F.col("source").eqNullSafe("page"), REPORT).otherwise(QUARANTINE)
    said = lambda name: F.when(F.size(name + "s") > 0, F.concat(F.lit(f"{name} "), F.array_join(F.transform(name + "s", lambda d: d.cast("string")), " ")))
    return found.select(*finding("agreement_period", severity, F.concat_ws(" ", "subject", F.lower("outcome"), said("start"), said("end")))).distinct()
