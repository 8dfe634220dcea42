"""The whole cascade of reference rules: within a file, over its pages, in question logs and in amendments.

Every rule gives candidates: a mention, a page, and how many targets there are
with which one first, counted per day of publication. Targets are counted per page
before mentions meet them, so that a page of many files, or a title that many
sections share, costs a mention one row. The first rule with a candidate decides;
one target on every page is a resolution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.lineage import cut
from spandrel.operators.references import AMBIGUOUS, RESOLVED, SELF

NUMBER_MISSING, TITLE_MISSING, NOT_PUBLISHED, EXTERNAL, PLACEHOLDER = "number_missing", "title_missing", "not_published", "external", "placeholder"
LOG, TENDER, AMENDMENT, LICENCE, CARD = "questions_and_answers", "procurement_document", "amendment", "licence_terms", "supplier_agreement"
#: Types of the procurement group, whose files repeat the headings of others.
PROCUREMENT_GROUP = (LOG, TENDER)
# Names that stand for titles that don't start with them, names of a supplier's own card, and of the whole tender.
ALIASES = {"huvuddokument": ("ramavtalets huvuddokument", "volymavtalets huvudavtal"), "prisbilaga": ("timpriser",), "priser": ("prisbilaga", "timpriser"), "avropsvägledning": ("vägledning",), "upphandlingsdokumenten": ("upphandlingsdokument", "anbudsinbjudan", "ansökningsinbjudan")}
CARD_NAMES = ("huvuddokument", "ramavtalets huvuddokument", "huvuddokumentet")
PACKAGE = "upphandlingsdokumenten"
LOG_TITLE = r"^frågor och svar\s*-\s*(.+)$"
ANNEX_RANGE = r"(?iu)bilag(?:a|an|or|orna)\s+([0-9]{1,2}(?:\.[0-9]{1,2})?)(?:\s*[-–]\s*([0-9]{1,2}(?:\.[0-9]{1,2})?))?(?![0-9.])"
STAMP = r"([0-9]{4}-[0-9]{2}-[0-9]{2}) [0-9]{2}:[0-9]{2}"

KEY = ["doc", "position", "kind", "key", "named"]


def title_form(title: Column) -> Column:
    """Lower case, one blank between words, no soft hyphens and no "utkast till"."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.replace(F.lower(title), F.lit("­"), F.lit("")), r"(?U)\s+", " ")), "^utkast till ", "")


def heading_form(title: Column) -> Column:
    """Lower case without blanks, dots and colons at the end."""
    return F.regexp_replace(F.lower(title), "[ .:]+$", "")


def question_day(text: Column) -> Column:
    """The earliest time stamp of a section: when its question was asked."""
    stamps = F.regexp_extract_all(text, F.lit(STAMP), F.lit(1))
    return F.array_min(F.filter(F.transform(stamps, lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull()))


def _start(text: Column, words: int) -> Column:
    """The first one or two words of a text, with what stands before and between them; null if it has fewer."""
    found = F.regexp_extract(text, r"(?U)^[^\p{L}\p{N}]*[\p{L}\p{N}]+" + r"[^\p{L}\p{N}]+[\p{L}\p{N}]+" * (words - 1), 0)
    return F.when(found != "", found)


def beginning(phrases: DataFrame, starts: DataFrame, by: list[str], phrase: str, start: str) -> DataFrame:
    """phrases (by..., phrase) joined with the starts (by..., start) that begin them and end at a word's end: by the first two words, or the only one, then compared."""
    asked = phrases.withColumn("k_", F.explode(F.array_compact(F.array(_start(F.col(phrase), 1), _start(F.col(phrase), 2)))))
    held = starts.withColumn("k_", F.coalesce(_start(F.col(start), 2), _start(F.col(start), 1))).filter("k_ IS NOT NULL")
    follows = F.expr(f"substring({phrase}, length({start}) + 1, 1)")
    return asked.join(held, [*by, "k_"]).filter(F.startswith(F.col(phrase), F.col(start)) & ~follows.rlike(r"[\p{L}\p{N}]")).drop("k_")


#: Characters by which titles meet the names that they begin with, which may go on within a word.
SHORTEST = 3


def _titles_of(listed: DataFrame, starts: DataFrame) -> DataFrame:
    """listed (title, ...) joined with starts (name, start) of SHORTEST characters or more that begin the title."""
    key = lambda c: F.substring(c, 1, SHORTEST)
    met = listed.withColumn("k_", key(F.col("title"))).join(starts.filter(F.length("start") >= SHORTEST).withColumn("k_", key(F.col("start"))), "k_")
    return met.filter(F.startswith(F.col("title"), F.col("start"))).drop("k_", "start")


def _counted(targets: DataFrame, *by: str) -> DataFrame:
    """(by..., published, n, t, tender): targets (by..., doc_, position_, published, type) counted, with the smallest."""
    one = targets.select(*by, "doc_", F.col("position_").cast("long").alias("position_"), "published", "type").distinct()
    return one.groupBy(*by, "published").agg(F.count("*").alias("n"), F.min(F.struct("doc_", "position_")).alias("t"), F.bool_and(F.coalesce(F.col("type") == TENDER, F.lit(False))).alias("tender"))


def _summed(targets: DataFrame, *by: str) -> DataFrame:
    """_counted() of targets (by..., doc_, published, type, n_, position_) that stand for n_ sections of a file each, position_ the first."""
    one = targets.select(*by, "doc_", "n_", F.col("position_").cast("long").alias("position_"), "published", "type").distinct()
    return one.groupBy(*by, "published").agg(F.sum("n_").alias("n"), F.min(F.struct("doc_", "position_")).alias("t"), F.bool_and(F.coalesce(F.col("type") == TENDER, F.lit(False))).alias("tender"))


def nearest_in_outline(asked: DataFrame, headings: DataFrame) -> DataFrame:
    """asked (doc, number, head, ...) with n and t: of a file's sections with that heading those nearest to the number that asks.

    headings: (doc, position, number, level, head). Nearest is who shares the most
    leading parts of its number, at least the first; of those, the smallest level.
    Without a number, or with none in the same chapter, all count. Each heading is
    counted once for every beginning of its number, and the longest beginning that
    is met decides, so that equal headings aren't compared with each other.
    """
    return _nearest(asked, _equal_headings(headings))


def _equal_headings(headings: DataFrame) -> DataFrame:
    """(doc, number, level, head, n_, position): headings that differ in their position alone, counted, with the first."""
    return headings.groupBy("doc", "number", "level", "head").agg(F.count("*").alias("n_"), F.min("position").alias("position"))


def _nearest(asked: DataFrame, headings: DataFrame) -> DataFrame:
    """nearest_in_outline() of _equal_headings()."""
    beginnings = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda k: F.array_join(F.slice(F.split(c, r"\."), 1, k), "."))
    t = F.struct(F.col("doc").alias("doc_"), F.col("position").cast("long").alias("position_"))
    numbered = headings.filter("number IS NOT NULL AND number <> ''").withColumn("start_", F.explode(beginnings(F.col("number"))))
    levels = numbered.groupBy("doc", "head", "start_", "level").agg(F.sum("n_").alias("n"), F.min(t).alias("t"))
    near = levels.groupBy("doc", "head", "start_").agg(F.min_by(F.struct("n", "t"), "level").alias("near_"))
    every = headings.groupBy("doc", "head").agg(F.struct(F.sum("n_").alias("n"), F.min(t).alias("t")).alias("all_"))
    asked = asked.withColumn("from_", F.coalesce("number", F.lit("")))
    own = asked.select("doc", "from_", "head").distinct()
    found = own.filter("from_ <> ''").withColumn("start_", F.explode(beginnings(F.col("from_")))).join(near, ["doc", "head", "start_"])
    longest = found.groupBy("doc", "from_", "head").agg(F.max_by("near_", F.length("start_")).alias("near_"))
    met = own.join(every, ["doc", "head"]).join(longest, ["doc", "from_", "head"], "left").select("doc", "from_", "head", F.coalesce("near_", "all_").alias("x_"))
    return asked.join(met, ["doc", "from_", "head"]).withColumns({"n": F.col("x_.n"), "t": F.col("x_.t")}).drop("from_", "x_")


def _longest(met: DataFrame, keys: list[str]) -> DataFrame:
    """Of met (keys..., head, ...) the rows with the longest head of their keys."""
    most = met.groupBy(*keys).agg(F.max(F.length("head")).alias("most_"))
    return met.join(most, keys).filter(F.length("head") == F.col("most_")).drop("most_")


def covered_files(links: DataFrame, files: DataFrame) -> DataFrame:
    """(page, doc, covered): the other files that amendments amend, by the range of annexes in the amendment's title on that page."""
    first, last = F.regexp_extract("title", ANNEX_RANGE, 1), F.regexp_extract("title", ANNEX_RANGE, 2)
    named = links.join(files.filter(F.col("document_type") == AMENDMENT).select("doc"), "doc").select("page", "doc", first.alias("first"), F.coalesce(F.nullif(last, F.lit("")), first).alias("last")).filter("first <> ''")
    head, tail = (lambda c: F.regexp_replace(c, r"\.?[0-9]+$", "")), (lambda c: F.regexp_extract(c, r"([0-9]+)$", 1).cast("int"))
    annexes = links.select("page", F.col("doc").alias("covered")).distinct().join(files.filter("annex_number IS NOT NULL").select(F.col("doc").alias("covered"), "annex_number"), "covered").withColumn("head_", head(F.col("annex_number")))
    met = named.filter(head(F.col("first")) == head(F.col("last"))).withColumn("head_", head(F.col("first"))).join(annexes, ["page", "head_"])
    return met.filter(tail(F.col("annex_number")).between(tail(F.col("first")), tail(F.col("last"))) & (F.col("covered") != F.col("doc"))).select("page", "doc", "covered").distinct()


def resolve(mentions: DataFrame, sections: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, position, kind, key, named, status, rule, targets, page, target_doc, target_position).

    mentions: (doc, position, kind, key, named) as references.mentions() finds
    them; sections: (doc, position, number, title, level, text); links: (page,
    doc, title); files: (doc, document_type, annex_number, published_on), one row
    per file. The kinds and their rules, in order:

    section: R1x if a document is named with it; R1q in a question log; R1a in an amendment; R1 in the same file.
    title: R4q in a log; R4 in the same file, the nearest in its outline; R4a in an amendment; R4p on the page.
    annex: R3. annex_name: R5. document: R2. question: RQ in the same log.

    A log's ambiguous choice among tender documents is settled by the question's
    day: the latest that was published by then, if there is one and no other of
    unknown day. A resolved mention has a row per page, or one row with a null
    page if all pages agree; others have one row, with the smallest target if
    there is any. targets counts them. Null keys, numbers and titles match
    nothing; repeated rows count once; empty tables give no rows.
    """
    # One row per mention, with what its own section says. Mentions of a file that differ in their position alone have one outcome: the first of them is resolved.
    seen = sections.groupBy("doc", "position").agg(F.min("number").alias("own_number"), F.min(question_day(F.col("text"))).alias("day"))
    kinds = cut(files.groupBy("doc").agg(F.min("document_type").alias("type"), F.min("annex_number").alias("annex_number"), F.min("published_on").alias("published")))
    links = cut(links.select("page", "doc", title_form(F.col("title")).alias("title")).distinct())
    every = mentions.select(*KEY).distinct().join(seen, ["doc", "position"], "left")
    alike = ["doc", "kind", "key", "named", "own_number", "day"]
    m = cut(every.groupBy(*alike).agg(F.min("position").alias("position")).join(kinds.select("doc", "type"), "doc", "left"))
    is_ = lambda *names: F.col("kind").isin(*names)
    log, amends = F.coalesce(F.col("type") == LOG, F.lit(False)), F.coalesce(F.col("type") == AMENDMENT, F.lit(False))
    on_page = lambda d: d.join(links.select("page", "doc").distinct(), "doc")

    # What many rules read, and each rule's candidates, are computed once: the plans stay small.
    numbered = cut(sections.filter("number IS NOT NULL AND number <> ''").groupBy(F.col("doc").alias("doc_"), F.col("number").alias("key")).agg(F.min("position").alias("position_")))
    all_headings = sections.filter("title IS NOT NULL").select("doc", "position", "number", "level", heading_form(F.col("title")).alias("head")).filter("head <> ''")
    headings = cut(_equal_headings(all_headings))
    chapters = headings.filter("level = 1").select(F.col("doc").alias("doc_"), F.col("position").alias("position_"), "number", F.regexp_replace(title_form(F.col("head")), r"^utkast\s+", "").alias("name")).groupBy("doc_", "name").agg(F.min_by(F.struct("position_", "number"), "position_").alias("c")).select("doc_", "name", "c.*")
    about = kinds.select(F.col("doc").alias("doc_"), "type", "published")
    listed = cut(links.select("page", F.col("doc").alias("doc_"), "title").join(about, "doc_"))
    tenders = listed.filter(F.col("type") == TENDER).select("page", "doc_", "type", "published").distinct()

    blank = lambda kind: F.lit(None).cast(kind)
    parts: list[DataFrame] = []

    def add(found: DataFrame, rule: str, order: int, tier: int = 1) -> None:
        """found: KEY, day, page, published, n, t, tender."""
        parts.append(cut(found.select(*KEY, "day", F.lit(order).alias("order"), F.lit(rule).alias("rule"), "page", F.lit(tier).alias("tier"), "published", F.col("n").cast("long").alias("n"), "t", F.coalesce("tender", F.lit(False)).alias("tender"))))

    def inside(found: DataFrame) -> DataFrame:
        """found (KEY, day, position_) in the mention's own file, whatever its pages."""
        return found.withColumns({"page": blank(dict(links.dtypes)["page"]), "published": blank("date"), "n": F.lit(1), "t": F.struct(F.col("doc").alias("doc_"), F.col("position_").cast("long").alias("position_")), "tender": F.lit(False)})

    # Names of documents: a name and what it stands for, as beginnings of titles. They are as many as the forms of names are.
    given = m.filter(is_("document")).select(F.col("key").alias("name")).union(m.filter(is_("section") & (F.col("named") != "")).select("named"))
    stands = m.sparkSession.createDataFrame([(k, v) for k, some in ALIASES.items() for v in (k, *some)], "name string, start string")
    names = given.filter("name IS NOT NULL").distinct()
    starts = names.withColumn("start", F.col("name")).union(stands).distinct()
    called = cut(_titles_of(listed, starts).select("page", "name", "doc_", "type", "published").distinct())
    called_n = cut(_counted(called.withColumn("position_", blank("long")), "page", "name"))
    own_name = called.select(F.col("doc_").alias("doc"), "name").distinct()
    chapter_of = cut(chapters.join(starts.withColumnRenamed("name", "asked").withColumnRenamed("start", "name"), "name").groupBy(F.col("doc_").alias("doc"), F.col("asked").alias("name")).agg(F.min_by(F.struct("position_", "number"), "position_").alias("c")).select("doc", "name", "c.*"))

    # R2: the card itself, the file itself, a chapter of a tender document, the tender package, files of the page, a chapter of any other.
    docs = m.filter(is_("document")).withColumn("name", F.col("key"))
    itself = docs.filter((F.col("type") == CARD) & F.col("key").isin(*CARD_NAMES)).unionByName(docs.join(own_name, ["doc", "name"], "left_semi"))
    add(inside(itself.withColumn("position_", blank("long"))), "R2", 1)
    add(inside(docs.filter(F.col("type") == TENDER).join(chapter_of, ["doc", "name"])), "R2", 2)
    paged = on_page(docs)
    found2 = paged.join(called_n, ["page", "name"])
    add(inside(docs.join(found2.select(*KEY).distinct(), KEY, "left_anti").join(chapter_of, ["doc", "name"])), "R2", 3)
    group = listed.filter(F.col("type").isin(*PROCUREMENT_GROUP)).select("page", "doc_", "type", "published").distinct()
    package = paged.filter(F.col("key") == PACKAGE).drop("type").join(group, "page").filter("doc_ <> doc").withColumn("position_", blank("long"))
    add(_counted(package.select(*KEY, "day", "page", "doc_", "position_", "published", "type"), *KEY, "day", "page"), "R2", 4)
    add(found2, "R2", 5)

    # R1x: in the file itself, in a chapter of it, in the files of that name, in such a chapter of a tender document.
    with_name = m.filter(is_("section") & (F.col("named") != "")).withColumn("name", F.col("named"))
    own_number = numbered.withColumnRenamed("doc_", "doc")
    lies_in = (F.col("key") == F.col("number")) | F.startswith(F.col("key"), F.concat("number", F.lit(".")))
    of_itself = with_name.join(own_name, ["doc", "name"], "left_semi")
    add(inside(of_itself.join(own_number, ["doc", "key"])), "R1x", 1)
    elsewhere = with_name.join(of_itself.select(*KEY), KEY, "left_anti")
    add(inside(elsewhere.join(chapter_of.drop("position_"), ["doc", "name"]).filter(lies_in).join(own_number, ["doc", "key"])), "R1x", 2)
    numbered_called = called.join(numbered, "doc_").join(elsewhere.select("name", "key").distinct(), ["name", "key"], "left_semi")
    add(on_page(elsewhere).join(_counted(numbered_called, "page", "name", "key"), ["page", "name", "key"]), "R1x", 3)
    in_chapters = tenders.join(chapter_of.drop("position_").withColumnRenamed("doc", "doc_"), "doc_").join(numbered, "doc_").filter(lies_in).join(elsewhere.select("name", "key").distinct(), ["name", "key"], "left_semi")
    add(on_page(elsewhere).drop("type").join(in_chapters.withColumnRenamed("doc_", "d_"), ["page", "name", "key"]).filter("d_ <> doc").withColumnRenamed("d_", "doc_").transform(lambda d: _counted(d.select(*KEY, "day", "page", "doc_", "position_", "published", "type"), *KEY, "day", "page")), "R1x", 4)

    # In a log: the file that the log's title names and that was out by then, else the page's tender documents.
    log_name = links.withColumn("title", F.regexp_extract("title", LOG_TITLE, 1)).filter("title <> ''").join(kinds.filter(F.col("type") == LOG).select("doc"), "doc", "left_semi")
    log_files = cut(log_name.join(listed, ["page", "title"]).filter("doc_ <> doc").select("page", "doc", "doc_", "type", "published").distinct())
    in_time = F.coalesce(F.col("published") <= F.col("day"), F.lit(True))
    asks = on_page(m.filter(log))
    by_number = asks.filter(is_("section") & (F.col("named") == "")).drop("type")
    named_n = _counted(log_files.join(numbered, "doc_"), "page", "doc", "key")
    tender_n = _counted(tenders.join(numbered, "doc_"), "page", "key")
    add(by_number.join(named_n, ["page", "doc", "key"]).filter(in_time), "R1q", 5)
    add(by_number.join(tender_n, ["page", "key"]), "R1q", 5, tier=2)

    # Titles: phrases meet headings by their first words, per file or per page; the longest that fits decides in each file.
    titled = m.filter(is_("title")).withColumn("phrase", heading_form(F.col("key"))).filter("phrase IS NOT NULL")
    heads = cut(all_headings.select("doc", "position", "head").distinct().groupBy(F.col("doc").alias("doc_"), "head").agg(F.count("*").alias("n_"), F.min("position").alias("position_")))
    phrases = on_page(titled).select("page", "phrase").distinct()
    page_heads = listed.select("page", "doc_", "type", "published").distinct().join(heads.select("doc_", "head"), "doc_")
    met = beginning(phrases, page_heads, ["page"], "phrase", "head")
    matched = cut(_longest(met, ["page", "phrase", "doc_"]).join(heads, ["doc_", "head"]))
    say = asks.filter(is_("title")).withColumn("phrase", heading_form(F.col("key"))).drop("type")
    named_t = _summed(matched.drop("type", "published").join(log_files, ["page", "doc_"]), "page", "doc", "phrase")
    tender_t = _summed(matched.filter(F.col("type") == TENDER), "page", "phrase")
    add(say.join(named_t, ["page", "doc", "phrase"]).filter(in_time), "R4q", 6)
    add(say.join(tender_t, ["page", "phrase"]), "R4q", 6, tier=2)

    own_met = _longest(beginning(titled.select("doc", "phrase").distinct(), headings.select("doc", "head").distinct(), ["doc"], "phrase", "head"), ["doc", "phrase"])
    r4 = _nearest(titled.join(own_met, ["doc", "phrase"]).withColumn("number", F.col("own_number")), headings)
    add(r4.withColumns({"page": blank(dict(links.dtypes)["page"]), "published": blank("date"), "tender": F.lit(False)}), "R4", 7)

    # In an amendment: the annexes that its title names.
    covered = cut(covered_files(links, kinds.withColumnRenamed("type", "document_type")).withColumnRenamed("covered", "doc_").join(about, "doc_"))
    changes = m.filter(amends & is_("section") & (F.col("named") == ""))
    spelled = F.array_distinct(F.array(F.col("key"), F.regexp_replace("key", r"\.?[a-z]$", "")))
    wanted = on_page(changes).select("page", *KEY, "day", F.posexplode(spelled).alias("k_", "number")).join(covered.select("page", "doc", "doc_", "published", F.col("type").alias("type_")), ["page", "doc"])
    hit = wanted.join(numbered.withColumnRenamed("key", "number"), ["doc_", "number"]).groupBy(*KEY, "day", "page", "doc_", "published", "type_").agg(F.min_by("position_", "k_").alias("position_")).withColumnRenamed("type_", "type")
    add(_counted(hit, *KEY, "day", "page"), "R1a", 8)
    amended_t = _longest(matched.drop("type", "published").join(covered, ["page", "doc_"]), ["page", "doc", "phrase"])
    add(on_page(titled.filter(amends)).drop("type").join(_summed(amended_t, "page", "doc", "phrase"), ["page", "doc", "phrase"]), "R4a", 8)

    add(inside(m.filter(is_("section") & (F.col("named") == "") & ~log).join(own_number, ["doc", "key"])), "R1", 9)

    # R4p: the longest heading of the page; files of the procurement group only where no other has it.
    page_t = _longest(matched, ["page", "phrase"]).withColumn("late", F.coalesce(F.col("type").isin(*PROCUREMENT_GROUP), F.lit(False)))
    first = page_t.groupBy("page", "phrase").agg(F.min("late").alias("late"))
    page_t = page_t.join(first, ["page", "phrase", "late"])
    add(on_page(titled).drop("type").join(_summed(page_t, "page", "phrase"), ["page", "phrase"]), "R4p", 10)

    # R3 and R5: annexes by number and by name.
    annexes = listed.withColumn("key", F.regexp_extract("title", r"^bilaga ([0-9]+(?:\.[0-9]+)*)(?![0-9.])", 1)).filter("key <> ''").withColumn("position_", blank("long"))
    by_annex = m.filter(is_("annex") & ~F.coalesce(F.col("type") == LICENCE, F.lit(False)))
    add(inside(by_annex.join(annexes.select(F.col("doc_").alias("doc"), "key").distinct(), ["doc", "key"], "left_semi").withColumn("position_", blank("long"))), "R3", 0)
    add(on_page(by_annex).drop("type").join(_counted(annexes, "page", "key"), ["page", "key"]), "R3", 1)
    joined = lambda c: F.regexp_replace(c, r"(?<=[a-zåäö])-\s?(?=[a-zåäö])", "")
    by_name = on_page(m.filter(is_("annex_name"))).drop("type").withColumn("phrase", joined(title_form(F.col("key")))).filter("phrase IS NOT NULL")
    spelt = listed.withColumn("head", joined(F.col("title"))).withColumn("position_", blank("long"))
    long_names = _longest(beginning(by_name.select("page", "phrase").distinct(), spelt, ["page"], "phrase", "head"), ["page", "phrase"])
    mine = by_name.join(long_names.select("page", "phrase", F.col("doc_").alias("doc")).distinct(), ["page", "phrase", "doc"], "left_semi")
    add(inside(mine.drop("page").distinct().withColumn("position_", blank("long"))), "R5", 0)
    add(by_name.join(_counted(long_names, "page", "phrase"), ["page", "phrase"]), "R5", 1)
    alias = F.coalesce(*[F.when(F.col("phrase").rlike(rf"^{k}(?![\p{{L}}\p{{N}}])"), F.lit(k)) for k in ALIASES])
    stood = by_name.withColumn("name", alias).filter("name IS NOT NULL")
    add(inside(stood.join(own_name, ["doc", "name"], "left_semi").drop("page").distinct().withColumn("position_", blank("long"))), "R5", 2)
    add(stood.join(called_n, ["page", "name"]), "R5", 3)
    add(inside(m.filter(is_("question")).join(own_number, ["doc", "key"])), "RQ", 1)

    found = _decided(m, reduce(DataFrame.unionByName, parts), links, called)
    first = m.select(*alike, "position").toDF(*[f"{c}_" for c in alike], "position_")
    outcome = cut(_null_safe(found, first, KEY).drop(*KEY, "position_"))
    return _null_safe(every, outcome, alike).select(*found.columns)


def _null_safe(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a joined with b, whose columns of by end in a line; nulls are equal."""
    return a.join(b, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by]))


def _decided(m: DataFrame, candidates: DataFrame, links: DataFrame, called: DataFrame) -> DataFrame:
    """The outcome of each mention from its candidates."""
    best = candidates.groupBy(*KEY).agg(F.min(F.struct("order", "rule")).alias("b")).select(*KEY, "b.*")
    kept = candidates.drop("rule").join(best, [*KEY, "order"])
    per = Window.partitionBy(*KEY, "page")
    kept = kept.withColumn("least_", F.min("tier").over(per)).filter("tier = least_")
    in_time = F.col("published").isNull() | (F.col("published") <= F.col("day"))
    dated = F.col("published").isNotNull() & in_time
    pages = kept.groupBy(*KEY, "rule", "day", "page").agg(
        F.sum("n").alias("n"),
        F.min("t").alias("t"),
        F.bool_and("tender").alias("tender"),
        F.bool_or((F.col("t.doc_") == F.col("doc")) & F.col("t.position_").isNull()).alias("self"),
        F.sum(F.when(in_time, F.col("n"))).alias("out"),
        F.min(F.when(in_time, F.col("t"))).alias("out_t"),
        F.coalesce(F.sum(F.when(F.col("published").isNull(), F.col("n"))), F.lit(0)).alias("undated"),
        F.max_by(F.when(dated, F.struct("n", "t")), F.when(dated, F.col("published"))).alias("latest"),
    )
    # What the day of the question leaves: one that was out by then, or the latest of several that are all dated.
    whole = (F.col("kind") == "document") & (F.col("key") == PACKAGE)
    settled = F.when(F.col("out") == 1, F.col("out_t")).when(~whole & (F.col("undated") == 0) & (F.col("latest.n") == 1), F.col("latest.t"))
    pages = cut(pages.withColumn("settled", F.when(F.col("day").isNotNull(), settled)))
    outcome = pages.groupBy(*KEY, "rule").agg(F.sum("n").alias("targets"), F.max("n").alias("most"), F.min("t").alias("t"), F.bool_or("self").alias("self"), F.bool_and(F.col("tender") & F.col("settled").isNotNull()).alias("by_day"))
    outcome = outcome.join(m.select(*KEY, "type"), KEY)
    status = F.when(F.col("self"), SELF).when(F.col("most") == 1, RESOLVED).when(F.col("by_day") & F.coalesce(F.col("type") == LOG, F.lit(False)), RESOLVED).otherwise(AMBIGUOUS)
    outcome = cut(outcome.withColumn("status", status))

    # Resolved: a row per page, or one if all pages agree.
    done = pages.join(outcome.filter(F.col("status") == RESOLVED).select(*KEY, "most"), KEY).withColumn("t", F.when(F.col("most") == 1, F.col("t")).otherwise(F.col("settled")))
    agree = done.groupBy(*KEY).agg((F.min("t") == F.max("t")).alias("agree"))
    one = done.select(*KEY, "rule", "t").distinct().join(agree.filter("agree"), KEY).select(*KEY, F.lit(RESOLVED).alias("status"), "rule", F.lit(1).cast("long").alias("targets"), F.lit(None).cast(dict(links.dtypes)["page"]).alias("page"), "t")
    several = done.join(agree.filter("NOT agree"), KEY).join(done.groupBy(*KEY).agg(F.count("*").alias("targets")), KEY).select(*KEY, F.lit(RESOLVED).alias("status"), "rule", "targets", "page", "t")
    rest = outcome.filter(F.col("status") != RESOLVED).select(*KEY, "status", "rule", "targets", F.lit(None).cast(dict(links.dtypes)["page"]).alias("page"), "t")

    # Nothing found: what the last rule that applies says.
    named = m.filter("kind = 'section' AND named <> ''").join(links.select("page", "doc").distinct(), "doc").join(called.select("page", F.col("name").alias("named")).distinct(), ["page", "named"], "left_semi").select(*KEY).distinct().withColumn("has_", F.lit(True))
    left = m.join(outcome.select(*KEY), KEY, "left_anti").join(named, KEY, "left")
    kind, log = F.col("kind"), F.coalesce(F.col("type") == LOG, F.lit(False))
    with_name = (kind == "section") & (F.col("named") != "")
    missing = (
        F.when(kind == "law", EXTERNAL).when(kind == "placeholder", PLACEHOLDER).when(with_name & F.col("has_").isNull(), NOT_PUBLISHED)
        .when(kind.isin("section", "question"), NUMBER_MISSING).when(kind == "title", TITLE_MISSING).otherwise(NOT_PUBLISHED)
    )
    rule = F.when(with_name, "R1x").when((kind == "section") & log, "R1q").when(kind == "section", "R1").when(kind == "title", "R4").when(kind == "annex", "R3").when(kind == "annex_name", "R5").when(kind == "document", "R2").when(kind == "question", "RQ")
    none = left.select(*KEY, missing.alias("status"), rule.alias("rule"), F.lit(0).cast("long").alias("targets"), F.lit(None).cast(dict(links.dtypes)["page"]).alias("page"), F.lit(None).cast(dict(outcome.dtypes)["t"]).alias("t"))
    found = one.unionByName(several).unionByName(rest).unionByName(none)
    return found.select(*KEY, "status", "rule", "targets", "page", F.col("t.doc_").alias("target_doc"), F.col("t.position_").alias("target_position"))
