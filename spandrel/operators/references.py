"""Facts and references in texts: mentions, their resolution by rules in order, and amendments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import dates, identifiers


def identifiers_in(blocks: DataFrame) -> DataFrame:
    """(doc, position, kind, value, role): procurement and organisation numbers; those inside parentheses are citations."""
    number = r"23\.[0-9][-–.][0-9]{2,7}[-–][0-9]{2,4}(?:[-–:][0-9]{2,3}(?:-[A-Z])?)?"
    inside = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda p: F.regexp_extract_all(p, F.lit(number), F.lit(0))))
    outside = F.regexp_extract_all(F.regexp_replace("text", r"\([^()]*\)", " "), F.lit(number), F.lit(0))
    as_facts = lambda values, kind, role: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(role).alias("role")))
    orgs = identifiers.find_org_numbers(F.col("text"))
    facts = F.concat(as_facts(outside, "procurement", "self"), as_facts(inside, "procurement", "citation"), as_facts(orgs, "organisation", "self"))
    return blocks.select("doc", "position", F.explode(facts).alias("f")).select("doc", "position", "f.*").distinct()


# Month names.
MONTHS = "januari februari mars april maj juni juli augusti september oktober november december".split()


def dates_in(text: Column) -> Column:
    """array<date>: ISO dates and dates with a month's name, invalid ones dropped."""
    iso = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"), F.lit(0)), lambda d: dates.iso_date(d))
    month = F.array(*[F.lit(m) for m in MONTHS])
    form = rf"(?iu)\b([0-9]{{1,2}})\s+({'|'.join(MONTHS)})\s+([0-9]{{4}})\b"
    named = F.transform(
        F.regexp_extract_all(text, F.lit(form), F.lit(0)),
        lambda d: F.try_to_date(F.concat_ws("-", F.regexp_extract(d, form, 3), F.lpad(F.array_position(month, F.lower(F.regexp_extract(d, form, 2))).cast("string"), 2, "0"), F.lpad(F.regexp_extract(d, form, 1), 2, "0")), "yyyy-MM-dd"),
    )
    return F.filter(F.concat(iso, named), lambda d: d.isNotNull())


def period_in(text: Column) -> Column:
    """struct<start, end> of the first "date - date"; null if either isn't a date."""
    form = r"([0-9]{4}-[0-9]{2}-[0-9]{2})\s*(?:[-–—]|till|to)\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"
    start, end = dates.iso_date(F.regexp_extract(text, form, 1)), dates.iso_date(F.regexp_extract(text, form, 2))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


_SECTION, _ANNEX = r"(?:avsnitt(?:et|en)?|punkt(?:en|erna)?|kapitel|sections?|clauses?)", r"(?:bilag(?:a|an|or|orna)|annex(?:es)?)"
_DOCUMENT = r"(?:allmänna villkor(?:en)?|kravkatalog(?:en)?|huvuddokument(?:et)?|general terms|requirements catalogue)"
_NUMBERS = r"\d+(?:\.\d+)*(?:\s*(?:,|och|and|samt|eller|or)\s*\d+(?:\.\d+)*)*"
_LAW = r"(?iu)(?:\d+(?:\.\d+)*\s+)?(?:§\s*\d+[^.]{0,40})?(?:lag(?:en)?|förordning(?:en)?)\s*\(\d{4}:\d+\)(?:[^.]{0,30}?\d+\s*(?:kap\.?|§))?"
#: Forms of mentions, each read from what the earlier ones left: (kind, pattern, group of the key, group of the document named with it).
_FORMS = (
    ("placeholder", rf"(?iu)(?:{_SECTION}|{_ANNEX})\s+(\[[^\]\d]{{0,20}}\]|x+(?:\.x+)*\b|…+|\.{{3,}})", 1, None),
    ("section", rf"(?iu){_SECTION}\s+(\d+(?:\.\d+)*)\s+(?:i|av|of|in)\s+(?:de\s+|the\s+)?({_DOCUMENT})", 1, 2),
    ("section", rf"(?iu){_SECTION}\s+({_NUMBERS})", 1, None),
    ("annex", rf"(?iu){_ANNEX}\s+({_NUMBERS})", 1, None),
    ("annex_name", r"(?U)(?:[Bb]ilagan?|[Aa]nnex)\s+(\p{Lu}[\p{L} -]{2,60}?)(?=\s*[.,;:)]|$)", 1, None),
    ("document", rf"(?iu)\b({_DOCUMENT})\b", 1, None),
    ("title", r"(?U)(?:[Aa]vsnittet|[Aa]vsnitt|[Ss]ection)\s+[\"”»]?(\p{Lu}[^.;,\n\"”»]{2,200})", 1, None),
    ("question", r"(?iu)(?:fråga|question)\s+(?:nr\.?\s*)?(\d+)", 1, None),
)


def mentions(sections: DataFrame) -> DataFrame:
    """(doc, position, kind, key, named, replaces): references in sections (doc, position, text) to laws, sections, annexes, documents and questions.

    Laws are claimed first: a number in or right before a law is no section
    reference. Then each form takes what it matches from the sentence, so that
    later forms don't read it again. A list of numbers is a mention each. named is
    the document that a section number was given with, else empty. A mention
    replaces if its sentence has a verb of replacement that is neither negated nor
    conditional.
    """
    sentences = sections.select("doc", "position", F.explode(F.split("text", r"(?<=[.!?])\s+(?=\p{Lu})")).alias("sentence"))
    verb, doubt = r"(?iu)\b(ersätts?|ersätter|upphävs|utgår|ändras|replaces?|replaced|superseded?)\b", r"(?iu)\b(inte|ej|om|kan komma att|not|if|may)\b"
    read = sentences.withColumn("replaces", F.col("sentence").rlike(verb) & ~F.col("sentence").rlike(doubt)).withColumn("rest_0", F.regexp_replace("sentence", _LAW, " "))
    every = [_tagged(F.regexp_extract_all("sentence", F.lit(r"\((\d{4}:\d+)\)"), F.lit(1)), "law")]
    for n, (kind, pattern, group, with_) in enumerate(_FORMS):
        rest, keys = F.col(f"rest_{n}"), F.col(f"keys_{n}")
        # Most sentences have few of the forms: only where one is found is its text taken away.
        read = read.withColumn(f"keys_{n}", F.regexp_extract_all(rest, F.lit(pattern), F.lit(group)))
        if with_:
            read = read.withColumn(f"names_{n}", F.when(F.size(keys) > 0, F.regexp_extract_all(rest, F.lit(pattern), F.lit(with_))).otherwise(F.array().cast("array<string>")))
            every.append(F.transform(F.arrays_zip(keys.alias("k"), F.col(f"names_{n}").alias("n")), lambda x: F.struct(F.lit("section").alias("kind"), x["k"].alias("key"), F.lower(x["n"]).alias("named"))))
        else:
            each = F.flatten(F.transform(keys, lambda k: F.regexp_extract_all(k, F.lit(r"\d+(?:\.\d+)*"), F.lit(0)))) if kind in ("section", "annex") else keys
            every.append(_tagged(each, kind))
        read = read.withColumn(f"rest_{n + 1}", F.when(F.size(keys) > 0, F.regexp_replace(rest, pattern, " ")).otherwise(rest))
    found = read.select("doc", "position", "replaces", F.explode(F.concat(*every)).alias("m"))
    return found.select("doc", "position", "m.kind", F.lower(F.trim("m.key")).alias("key"), "m.named", "replaces").distinct()


def _tagged(keys: Column, kind: str) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.lit("").alias("named")))


RESOLVED, AMBIGUOUS, UNRESOLVED, SELF = "resolved", "ambiguous", "unresolved", "self"


def _prefixes(text: Column) -> Column:
    """array<string>: the beginnings of a text that end with a word, in lower case."""
    pieces = F.split(F.lower(text), r"(?<=[\p{L}\p{N}])(?![\p{L}\p{N}])")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), "")))


def _name_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+$", "")


def resolve(found: DataFrame, sections: DataFrame, files: DataFrame) -> DataFrame:
    """found mentions with status, rule, target_doc and target_position.

    sections: (doc, position, number, title); files: (page, doc, title, annex, document_type).
    Rules in order: R1 a section of that number in the same file; R1x one in the
    file on the page that is named with it; R2 a file on the page whose title
    starts with the name; R3 an annex of that number on the page; R4 the section of
    the same file whose title is the longest beginning of the phrase; R4p such a
    section of another file on the page; R5 an annex on the page of that name; RQ a
    question of that number in a question log on the page. One target is resolved,
    several are ambiguous, and what names the file itself is its own. Files on a page
    meet mentions by page and number, or page and the beginnings of names.
    """
    # No rule asks where in its file a mention stands: equal mentions of a file are resolved once.
    key = ["doc", "kind", "key", "named"]
    asked = found.select(*key).distinct()
    numbered = sections.filter("number IS NOT NULL").groupBy(F.col("doc").alias("target_doc"), "number").agg(F.min("position").alias("target_position"))
    on_page = asked.join(files.select("page", "doc").distinct(), "doc")
    own = files.select("page", F.col("doc").alias("target_doc"), F.col("title").alias("file_title"), "annex", "document_type").distinct()
    none = F.lit(None).cast(sections.schema["position"].dataType).alias("target_position")
    of = lambda kind, extra="true": F.expr(f"kind = '{kind}' AND {extra}")
    titled = own.select("page", "target_doc", F.explode(_prefixes(F.col("file_title"))).alias("name")).distinct()
    named = lambda d, column: d.withColumn("name", _name_form(F.col(column))).join(titled, ["page", "name"])

    r1 = asked.filter(of("section", "named = ''")).join(numbered.withColumnRenamed("number", "key").withColumn("doc", F.col("target_doc")), ["doc", "key"])
    r1x = named(on_page.filter(of("section", "named <> ''")), "named").join(numbered.withColumnRenamed("number", "key"), ["target_doc", "key"])
    r2 = named(on_page.filter(of("document")), "key").withColumn("target_position", none)
    r3 = on_page.filter(of("annex")).join(own.withColumnRenamed("annex", "key"), ["page", "key"]).withColumn("target_position", none)
    plain = F.regexp_replace("file_title", rf"(?iu)^{_ANNEX}\s*(?:\d+(?:\.\d+)*)?[\s:.–-]*", "")
    annexes = own.withColumn("plain", plain).filter(F.col("plain") != F.col("file_title")).select("page", "target_doc", F.explode(_prefixes(F.col("plain"))).alias("name")).distinct()
    r5 = on_page.filter(of("annex_name")).withColumn("name", _name_form(F.col("key"))).join(annexes, ["page", "name"]).withColumn("target_position", none)
    rq = on_page.filter(of("question")).join(own.filter("document_type = 'question_log'").select("page", "target_doc").distinct(), "page").join(numbered.withColumnRenamed("number", "key"), ["target_doc", "key"])
    rules = {"R1": (0, r1), "R1x": (1, r1x), "R2": (2, r2), "R3": (3, r3), "R5": (6, r5), "RQ": (7, rq)}
    by = lambda n, rule: F.struct(F.lit(n).alias("priority"), F.lit(rule).alias("rule")).alias("by")
    parts = [d.select(*key, by(n, rule), F.struct("target_doc", "target_position").alias("t")) for rule, (n, d) in rules.items()]
    targets = reduce(DataFrame.unionByName, parts).distinct().groupBy(*key, "by").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.bool_or((F.col("t.target_doc") == F.col("doc")) & F.col("t.target_position").isNull()).alias("self"))

    # Titles are counted per file and per page before phrases meet them, so that common titles cost one row.
    heads = sections.filter("title IS NOT NULL").select(F.col("doc").alias("target_doc"), F.col("position").alias("target_position"), _name_form(F.col("title")).alias("head")).filter("head <> ''")
    counted = lambda d, on: d.groupBy(on, "head").agg(F.count("*").alias("n"), F.min(F.struct("target_doc", "target_position")).alias("t"))
    longest = lambda met: met.groupBy(*key).agg(F.max_by(F.struct("n", "t"), F.length("head")).alias("x")).select(*key, "x.*", F.lit(False).alias("self"))
    phrases = asked.filter(of("title")).withColumn("head", F.explode(_prefixes(F.col("key"))))
    r4 = longest(phrases.join(counted(heads, "target_doc").withColumnRenamed("target_doc", "doc"), ["doc", "head"]))
    elsewhere = counted(heads.join(own.select("page", "target_doc").distinct(), "target_doc"), "page")
    far = phrases.join(r4.select(*key), key, "left_anti").join(files.select("page", "doc").distinct(), "doc")
    r4p = longest(far.join(elsewhere, ["page", "head"]))
    targets = targets.unionByName(r4.withColumn("by", by(4, "R4"))).unionByName(r4p.withColumn("by", by(5, "R4p")))
    best = targets.groupBy(*key).agg(F.min(F.struct("by", "n", "t", "self")).alias("x")).select(*key, "x.*")
    status = F.when(F.col("n").isNull(), UNRESOLVED).when(F.col("self"), SELF).when(F.col("n") > 1, AMBIGUOUS).otherwise(RESOLVED)
    return found.join(best, key, "left").select("doc", "position", "kind", "key", "named", "replaces", status.alias("status"), F.col("by.rule").alias("rule"), F.col("t.target_doc").alias("target_doc"), F.col("t.target_position").alias("target_position"))


def resolution_rate(references: DataFrame) -> DataFrame:
    """(resolved, counted, rate) without laws, questions and references to the file itself; 0 when nothing counts."""
    counted = references.filter("kind NOT IN ('law', 'question') AND status <> 'self'")
    done = F.count_if(F.col("status") == RESOLVED)
    return counted.agg(done.alias("resolved"), F.count("*").alias("counted"), F.round(F.coalesce(done / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 9).alias("rate"))


def latest_on(questions: DataFrame, versions: DataFrame, by: list[str]) -> DataFrame:
    """questions (by..., day) with version: the newest of versions (by..., published_on, version) up to the day, if there is just one and none is undated.

    Days are merged per key after versions and questions are aggregated by day, so
    that a key costs as many rows as it has days.
    """
    dated = versions.filter("published_on IS NOT NULL").groupBy(*by, F.col("published_on").alias("day")).agg(F.struct(F.count("*").alias("n"), F.min("version").alias("version")).alias("x_"))
    asked = questions.select(*by, "day").distinct()
    both = dated.unionByName(asked.withColumn("x_", F.lit(None).cast(dated.schema["x_"].dataType))).groupBy(*by, "day").agg(F.max("x_").alias("x_"))
    newest = both.withColumn("x_", F.last("x_", ignorenulls=True).over(Window.partitionBy(*by).orderBy("day")))
    unknown = versions.filter("published_on IS NULL").select(*by).distinct().withColumn("unknown_", F.lit(True))
    met = questions.join(newest, [*by, "day"], "left").join(unknown, by, "left")
    return met.withColumn("version", F.when(F.col("unknown_").isNull() & (F.col("x_.n") == 1), F.col("x_.version"))).select(*questions.columns, "version")


def annex_range(mentions_: DataFrame, annexes: DataFrame) -> DataFrame:
    """Annexes (page, number) in the ranges (page, first, last) of mentions_: same dotted beginning, last part between."""
    head = lambda c: F.regexp_replace(c, r"\.?\d+$", "")
    tail = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("int")
    m = mentions_.select("page", "first", "last", head(F.col("first")).alias("head"), tail(F.col("first")).alias("low"), tail(F.col("last")).alias("high")).filter(head(F.col("last")) == F.col("head"))
    a = annexes.select("page", "number", head(F.col("number")).alias("head"), tail(F.col("number")).alias("part"))
    return m.join(a, ["page", "head"]).filter(F.col("part").between(F.col("low"), F.col("high"))).select("page", "first", "last", "number")


def amendments(references: DataFrame, sections: DataFrame, metadata: DataFrame) -> DataFrame:
    """(target_doc, target_position, doc, position, day): resolved replacing references; a null target position is the whole file.

    day is the last date in the amending section's text, or its file's version date.
    """
    replacing = references.filter(f"replaces AND status = '{RESOLVED}' AND NOT (target_doc = doc AND target_position <=> position)")
    read = replacing.join(sections.select("doc", "position", F.array_max(dates_in(F.col("text"))).alias("stamp")), ["doc", "position"]).join(metadata.select("doc", "version_date"), "doc", "left")
    return read.select("target_doc", "target_position", "doc", "position", F.coalesce("stamp", "version_date").alias("day")).distinct()


def longest_prefix(phrases: DataFrame, titles: DataFrame, by: list[str]) -> DataFrame:
    """phrases (by..., phrase) with the longest titles (by..., title) that start them and end at a word; ties are kept."""
    start = F.col("phrase").startswith(F.col("title")) & ~F.expr("substring(phrase, length(title) + 1, 1)").rlike(r"[\p{L}\p{N}]")
    met = phrases.join(titles, by).filter(start)
    w = Window.partitionBy(*by, "phrase").orderBy(F.desc(F.length("title")))
    return met.withColumn("rank_", F.rank().over(w)).filter("rank_ = 1").drop("rank_")
