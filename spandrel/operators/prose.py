"""Register values in the prose of answers: found in order, and judged against what backs them.

Numbers, organisations and dates are read from a text one form after another,
each from what the earlier forms have left unclaimed, so that their places are
known. Everything after that is joins on the draft: values with the rows of the
agreements that the draft declares, sentences with the agreements they name, dates
with what their sentence's offsets give from backed dates, and calculations, step
by step, with the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import dates, identifiers, text
from spandrel.functions.lineage import cut
from spandrel.functions.spans import between, claimed, spans
from spandrel.operators.references import MONTHS

# The forms in which values, offsets and calculations are written.
HYPHENS = ("‐‑−", "---")
STEP_HYPHENS = ("‐‑‒–−", "-----")
NUMBER = rf"(?<![0-9.]){identifiers.CASE}(?![0-9])(?:[-–:](?:[0-9]{{2,3}}(?![0-9])(?:-[A-Z](?!\p{{L}}))?|[0-9]+))?"
SHORT = r"(?U)(?<![\w.:\-–])[-–][0-9]{3}(?![\w\-–:]|[.,][0-9])"
RANGE = r"(?iu)^(?:\s+(?:till(?:\s+och\s+med)?|t\.o\.m\.)\s+)?$"
VAT = r"(?U)(?<!\w)SE\s?[0-9]{6}-?[0-9]{4}\s?01(?![0-9])"
ORGANISATION = r"(?<![0-9+-])[0-9]{6}\s?[-–]\s?[0-9]{4}(?![0-9-])"
ISO_DATE = r"(?<![0-9])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9])"
LONG_DATE = rf"(?iu)(?<![0-9.])[0-9]{{1,2}}(?::[ae])?\s+(?:{'|'.join(MONTHS)})\s+(?:19|20)[0-9]{{2}}(?![0-9])"
ABBREVIATIONS = "bl.a ca dvs d.v.s enl exkl f.d inkl jfr kap m.m nr org.nr p resp s.k st t.ex".split()
_DAYS, _WEEKS = "(?:arbets|kalender)?dag", "veck"
OFFSET = rf"(?iuU)(?<![\w.,])(?:[0-9]{{1,3}}|[^\W0-9_]+)(?:\s*\([0-9]{{1,3}}\))?\s+(?:{_DAYS}(?:ar|ars|s)?|{_WEEKS}(?:a|as|or|ors)|månad(?:er|ers|s)?|års?)(?!\w)"
MOVE = rf"(?:plus|minus|\+|-)\s*[0-9]{{1,4}}\s+(?:{_DAYS}(?:ar)?|{_WEEKS}(?:a|or)|månad(?:er)?|år)\s*=\s*[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?![0-9])"
CHAIN = rf"(?iu)(?<![0-9-])[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\s+{MOVE}(?:\s*,\s*{MOVE})*"
LEGAL_FORM = r"^(?:AB|Aktiebolaget)\s+|\s+(?:AB|Aktiebolag|Oy|Oyj|AS|A/S|ApS|Ltd\.?|Limited|GmbH|Inc\.?|B\.?V\.?)(?:\s*\(publ\))?$|\s*\(publ\)$"
#: A shorter name would be found inside ordinary words.
SHORTEST_NAME = 3

#: A sentence ends at . ! or ? before a capital, not after an abbreviation or a number of one or two digits; or at a line break.
_SHORTENED = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
BREAK = rf"(?<=[.!?])(?<!\s[0-9]\.)(?<!\s[0-9][0-9]\.)(?<!(?:^|[\s(])(?iu:{_SHORTENED})\.)\s+(?=[A-ZÅÄÖ])|(?<!\s)\s*\n\s*"


#: What NUMBER matches as well: sections and ranges of sections, with two full stops, or with one and a serial of two digits.
_SECTIONS = r"^23\.[0-9](?:\.[0-9]+\.|\.[0-9]{2}[-–]|[-–][0-9]{2}\.)"


def _is_number(raw: Column) -> Column:
    """Whether a match of NUMBER is one."""
    return ~raw.rlike(_SECTIONS)


def scan(texts: DataFrame) -> DataFrame:
    """texts (draft, text) with sentences, found and chains: arrays of structs with their places, in order.

    Each form reads what those before it haven't claimed. A null text has none of them.
    """
    read = texts.select("draft", "text", F.translate("text", *HYPHENS).alias("t0"), F.translate("text", *STEP_HYPHENS).alias("ts"))
    read = read.withColumns({"numbers": F.filter(spans(F.col("t0"), NUMBER), lambda m: _is_number(m["raw"])), "t1": claimed(F.col("t0"), NUMBER, _is_number), "breaks": spans(F.col("t0"), BREAK), "chains": spans(F.col("ts"), CHAIN), "prose": claimed(F.col("ts"), CHAIN)})
    tagged = lambda kind, found: F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["raw"].alias("raw"), F.lit(None).cast("string").alias("gap")))
    read = read.withColumns({"vat": tagged("vat", spans(F.col("t1"), VAT)), "t2": claimed(F.col("t1"), VAT), "shorts": spans(F.col("t1"), SHORT)})
    read = read.withColumns({"orgs": tagged("organisation", spans(F.col("t2"), ORGANISATION)), "t3": claimed(F.col("t2"), ORGANISATION)})
    read = read.withColumns({"iso": tagged("iso", spans(F.col("t3"), ISO_DATE)), "long": tagged("long", spans(claimed(F.col("t3"), ISO_DATE), LONG_DATE))})
    # Full numbers and short forms follow one another: what lies between two of them tells a range.
    read = read.withColumn("numbered", F.array_sort(F.concat(tagged("number", F.col("numbers")), tagged("short", F.col("shorts")))))
    gap = lambda m, i: F.when(i > 0, between(F.col("t0"), F.try_element_at(F.col("numbered"), i)["end"], m["start"]))  # noqa: E731  element i, counted from 1, is the one before
    read = read.withColumn("numbered", F.transform("numbered", lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["raw"].alias("raw"), gap(m, i).alias("gap"))))
    starts = F.concat(F.array(F.lit(0)), F.transform("breaks", lambda b: b["end"]))
    ends = F.concat(F.transform("breaks", lambda b: b["start"]), F.array(F.length("t0")))
    sentences = F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda s, i: F.struct(i.alias("sentence"), s["start"].alias("start"), s["end"].alias("end"), between(F.col("text"), s["start"], s["end"]).alias("said"), between(F.col("prose"), s["start"], s["end"]).alias("prose")))
    return read.filter("text IS NOT NULL").select("draft", "text", sentences.alias("sentences"), F.array_sort(F.concat("numbered", "vat", "orgs", "iso", "long")).alias("found"), "chains")


def values(scanned: DataFrame) -> DataFrame:
    """(draft, sentence, at, kind, key, raw, procurement, valid, day, covers): the values of scanned texts.

    kind is agreement, procurement, organisation or date. A short form is the
    agreement of that sequence under the last full number before it in its
    sentence; without one it isn't a value. covers are the agreements between the
    ends of a range. valid is false for a number with digits that are no sequence
    and for an organisation with a wrong check digit; day is null for a date that
    the calendar doesn't have.
    """
    sentence = F.size(F.filter("sentences", lambda s: s["start"] <= F.col("v")["start"])) - 1
    rows = scanned.select("draft", "sentences", F.explode("found").alias("v")).select("draft", sentence.alias("sentence"), F.col("v.start").alias("at"), "v.kind", "v.raw", "v.gap")
    none = lambda kind: F.lit(None).cast(kind)

    numbered = rows.filter("kind IN ('number', 'short')")
    case = F.when(F.col("kind") == "number", identifiers.procurement_key(F.regexp_extract("raw", identifiers.CASE, 0)))
    tail = F.when(F.col("kind") == "number", F.regexp_extract("raw", identifiers.CASE + r"[-–:](.+)$", 6)).otherwise(F.substring("raw", 2, 3))
    numbered = numbered.withColumns({"case": case, "tail": tail})
    upto = Window.partitionBy("draft", "sentence").orderBy("at")
    numbered = numbered.withColumn("procurement", F.last("case", ignorenulls=True).over(upto)).filter("procurement IS NOT NULL")
    good = F.col("tail").rlike("^[0-9]{2,3}(?:-[A-Z])?$")
    numbered = numbered.withColumns({"good": good, "sequence": F.when(good, F.regexp_extract("tail", "^[0-9]+", 0).cast("int"))})
    first = F.lag("sequence").over(upto)
    spanned = F.when((F.col("kind") == "short") & (first + 1 < F.col("sequence")) & F.col("gap").rlike(RANGE), F.sequence(first + 1, F.col("sequence") - 1))
    variant = F.regexp_extract("tail", "-[A-Z]$", 0)
    suffix = F.when(F.col("good"), F.concat(F.lpad(F.col("sequence").cast("string"), 3, "0"), variant)).otherwise(F.col("tail"))
    whole = F.concat_ws("-", "procurement", F.nullif(suffix, F.lit("")))
    numbers = numbered.withColumn("covers", spanned).select(
        "draft", "sentence", "at", F.when(F.col("tail") == "", "procurement").otherwise("agreement").alias("kind"), whole.alias("key"), F.when(F.col("kind") == "short", whole).otherwise(F.col("raw")).alias("raw"),
        F.when(F.col("good") | (F.col("tail") == ""), F.col("procurement")).alias("procurement"), (F.col("good") | (F.col("tail") == "")).alias("valid"), none("date").alias("day"),
        F.coalesce(F.transform("covers", lambda n: F.concat_ws("-", F.col("procurement"), F.lpad(n.cast("string"), 3, "0"))), F.array().cast("array<string>")).alias("covers"),
    )

    digits = F.regexp_replace(F.when(F.col("kind") == "vat", F.regexp_replace("raw", r"\s?01$", "")).otherwise(F.col("raw")), "[^0-9]", "")
    org = F.concat(F.substring(digits, 1, 6), F.lit("-"), F.substring(digits, 7, 4))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract("raw", r"(\p{L}+)\s+[0-9]{4}$", 1)))
    long = F.concat_ws("-", F.regexp_extract("raw", "[0-9]{4}$", 0), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract("raw", "^[0-9]+", 0), 2, "0"))
    day = dates.iso_date(F.when(F.col("kind") == "long", long).otherwise(F.col("raw")))
    rest = rows.filter("kind NOT IN ('number', 'short')").withColumns({"org": F.when(F.col("kind").isin("vat", "organisation"), org), "day": F.when(F.col("kind").isin("iso", "long"), day)})
    spelled = F.regexp_replace(F.lower("raw"), r"\s+", " ")
    others = rest.select(
        "draft", "sentence", "at", F.when(F.col("org").isNotNull(), "organisation").otherwise("date").alias("kind"), F.coalesce("org", F.col("day").cast("string"), spelled).alias("key"), "raw",
        none("string").alias("procurement"), F.when(F.col("org").isNotNull(), identifiers.luhn_valid(F.col("org"))).otherwise(F.col("day").isNotNull()).alias("valid"), "day", F.array().cast("array<string>").alias("covers"),
    )
    return numbers.unionByName(others)


def _facts(found: DataFrame) -> DataFrame:
    """(draft, kind, key) of values, as often as they give it; an agreement also gives its procurement."""
    own = found.select("draft", "kind", "key")
    return own.union(found.filter("procurement IS NOT NULL").select("draft", F.lit("procurement"), "procurement"))


def _with_single(facts: DataFrame) -> DataFrame:
    """facts, and agreements as procurements: a number without sequence may be an agreement with a single supplier."""
    return facts.union(facts.filter("kind = 'agreement'").withColumn("kind", F.lit("procurement")).select(facts.columns))


def _name_forms(rows: DataFrame) -> DataFrame:
    """(draft, agreement, name, word): the suppliers' names of declared agreements with and without legal form, and the first word of each in lower case."""
    full = F.trim(F.regexp_replace("name", r"\s+", " "))
    names = rows.select("draft", "agreement", F.explode(F.concat(F.array("supplier_name"), F.coalesce("former_names", F.array().cast("array<string>")))).alias("name")).filter("name IS NOT NULL")
    forms = names.select("draft", "agreement", F.explode(F.array(full, F.trim(F.regexp_replace(full, rf"(?iu){LEGAL_FORM}", "")))).alias("name")).filter(F.length("name") >= SHORTEST_NAME)
    return forms.withColumn("word", F.lower(F.regexp_extract("name", r"(?U)\w+", 0))).filter("word <> ''").distinct()


def _words(of: Column) -> Column:
    """The words of a text in lower case, also without a final s, as a name may stand in the genitive."""
    words = F.regexp_extract_all(F.lower(of), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.concat(words, F.transform(words, lambda w: F.regexp_replace(w, "s$", ""))))


def _says(said: Column, name: Column) -> Column:
    return F.regexp_like(said, F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), name, F.lit(r"\E(?::?s)?(?!\w)")))


def offsets(sentences: DataFrame) -> DataFrame:
    """(draft, sentence, amount, unit) that sentences (draft, sentence, prose) write: digits in parentheses, else digits or a number word before the unit."""
    found = sentences.select("draft", "sentence", F.explode(F.regexp_extract_all("prose", F.lit(OFFSET), F.lit(0))).alias("raw"))
    inside, first = F.regexp_extract("raw", r"\(([0-9]+)\)", 1), F.regexp_extract("raw", r"(?U)^\w+", 0)
    amount = F.coalesce(F.nullif(inside, F.lit("")).cast("int"), text.number_of(first))
    return found.select("draft", "sentence", amount.alias("amount"), unit(F.regexp_extract("raw", r"(?U)(\w+)$", 1)).alias("unit")).filter("amount > 0").distinct()


def unit(word: Column) -> Column:
    """The unit that a word counts."""
    w = F.lower(word)
    return F.when(w.startswith("arbets"), "working_days").when(w.startswith("dag") | w.startswith("kalender"), "days").when(w.startswith("veck"), "weeks").when(w.startswith("månad"), "months").otherwise("years")


def _shifted(df: DataFrame, day: str, amount: str, out: str, days: DataFrame) -> DataFrame:
    """df with out, an array of the days that a shift gives: in working days, with the eves as working days and as days off."""
    eves = dates.add_working_days(dates.shift(df, day, amount, "unit", "a_", days), day, amount, "b_", days, eves_off=True)
    return eves.withColumn(out, F.array_distinct(F.array_compact(F.array("a_", F.when(F.col("unit") == "working_days", F.col("b_")))))).drop("a_", "b_")


def calculations(scanned: DataFrame, days: DataFrame) -> DataFrame:
    """(draft, chain, base, step, at, written, due, gives, ok): every step of the calculations written in scanned texts, done again.

    A step counts from the date written before it, or from the first one of its
    chain. due is what the first of these gives, gives are the days that the
    one which fits gives, and ok is null where a date isn't in the calendar or
    beyond its years: what comes after such a step, or after a wrong one, isn't read.
    """
    chains = scanned.select("draft", F.explode("chains").alias("c")).select("draft", F.col("c.start").alias("chain"), dates.iso_date(F.substring("c.raw", 1, 10)).alias("base"), F.explode(spans(F.col("c.raw"), rf"(?iu){MOVE}")).alias("m"))
    sign = F.when(F.col("m.raw").rlike(r"(?iu)^(?:plus|\+)"), 1).otherwise(-1)
    steps = chains.filter("base IS NOT NULL").select(
        "draft", "chain", "base", (F.col("chain") + F.col("m.end") - 10).alias("at"), F.substring("m.raw", -10, 10).alias("written"),
        (sign * F.regexp_extract("m.raw", r"^\D*([0-9]+)", 1).cast("int")).alias("amount"), unit(F.regexp_extract("m.raw", r"(?iuU)[0-9]\s+(\w+)", 1)).alias("unit"),
    )
    order = Window.partitionBy("draft", "chain").orderBy("at")
    steps = steps.withColumns({"step": F.row_number().over(order), "day": dates.iso_date(F.col("written"))})
    steps = steps.withColumn("from", F.coalesce(F.lag("day").over(order), "base"))
    done = _shifted(_shifted(steps, "from", "amount", "near_", days), "base", "amount", "far_", days)
    fits = F.when(F.array_contains("near_", F.col("day")), F.col("near_")).when(F.array_contains("far_", F.col("day")), F.col("far_"))
    known = F.col("day").isNotNull() & (F.size("near_") > 0) & (F.size("far_") > 0)
    judged = done.withColumns({"gives": fits, "due": F.element_at(F.when(F.size("near_") > 0, F.col("near_")), 1), "ok": F.when(known, fits.isNotNull())})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    read = judged.withColumn("open_", F.coalesce(F.min(F.coalesce("ok", F.lit(False)).cast("int")).over(before), F.lit(1))).filter("open_ = 1")
    return read.select("draft", "chain", "base", "step", "at", "written", "due", "gives", "ok")


def stepped(steps: DataFrame, bases: DataFrame) -> DataFrame:
    """(draft, day): what right calculations give that start from bases (draft, day), or from what other right ones give, until nothing is added.

    The chains of one text are folded in one row: in as many rounds as it has
    chains, each reaches whatever it can.
    """
    chains = steps.filter("ok").groupBy("draft", "chain", "base").agg(F.flatten(F.collect_list("gives")).alias("results"))
    per = chains.groupBy("draft").agg(F.collect_list(F.struct("base", "results")).alias("chains")).join(bases.groupBy("draft").agg(F.collect_set("day").alias("bases")), "draft")
    add = lambda got, _: F.array_union(got, F.flatten(F.transform(F.filter("chains", lambda c: F.array_contains("bases", c["base"]) | F.array_contains(got, c["base"])), lambda c: c["results"])))
    return per.select("draft", F.explode(F.aggregate(F.sequence(F.lit(1), F.size("chains")), F.array().cast("array<date>"), add)).alias("day"))


def register_prose(drafts: DataFrame, declared: DataFrame, register: DataFrame, passages: DataFrame, days: DataFrame, today: Column, withdrawn: DataFrame | None = None) -> DataFrame:
    """(draft, at, kind, raw, problem, due): what drafts say of the register that nothing backs.

    drafts: (draft, text), one row each; declared: (draft, number), the agreements
    that a draft takes its facts from; register: (agreement_number, supplier_name,
    former_names, org_number, valid_from, valid_to, max_extension_to); passages:
    (draft, text), cited sections and the user's own words; days: the calendar;
    withdrawn: (draft, number), agreements that the register hasn't any more, or not
    yet, for a draft, though its rows have them for others.

    Problems: not_a_number, unknown and unused (a declared number, at null),
    malformed, unbacked, check_digit, not_of_named (an organisation or date of
    other agreements than those its sentence names), no_such_day, and calculation,
    where due is the date that it should give. A value is backed by the rows of
    the declared agreements, by a passage, or by being today; in a sentence that
    names declared agreements, organisations and dates by those agreements' rows,
    and a passage doesn't back what the register gives to another one. A date is
    also backed if its sentence's offsets lead to it from a backed date, give or
    take a day, unless it is a day off a date of the register; and if a right
    calculation gives it. Null texts and numbers give nothing; no rows give no rows.
    """
    drafts, days = drafts.filter("text IS NOT NULL"), cut(days)
    scanned = cut(scan(drafts))
    found = cut(values(scanned))
    sentences = scanned.select("draft", F.explode("sentences").alias("s")).select("draft", "s.sentence", "s.said", "s.prose")

    # What is declared, and what the register has of it.
    numbers = declared.filter("number IS NOT NULL").select("draft", "number").distinct()
    keyed = cut(numbers.join(numbers.select("number").distinct().withColumn("agreement", identifiers.agreement_key(F.col("number"))), "number"))
    wrong_number = keyed.filter("agreement IS NULL").select("draft", "number", F.lit("not_a_number").alias("problem"))
    keyed = keyed.filter("agreement IS NOT NULL").groupBy("draft", "agreement").agg(F.min("number").alias("number"))
    listed = cut(register.select("agreement_number").distinct().withColumn("agreement", identifiers.agreement_key(F.col("agreement_number")))).filter("agreement IS NOT NULL")
    in_force, lacking = keyed, keyed.join(listed.select("agreement").distinct(), "agreement", "left_anti")
    if withdrawn is not None:
        gone = cut(withdrawn.select("draft", identifiers.agreement_key(F.col("number")).alias("agreement")).distinct()).filter("agreement IS NOT NULL")
        in_force = keyed.join(gone, ["draft", "agreement"], "left_anti")
        lacking = lacking.unionByName(keyed.join(gone, ["draft", "agreement"], "left_semi")).distinct()
    lacking = cut(lacking)
    rows = cut(in_force.join(register.join(listed, "agreement_number"), "agreement"))

    single = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    procurement = F.regexp_replace("agreement", r"^(.*?[0-9]{4})-[0-9]{3}(?:-[A-Z])?$", "$1")
    each = F.array(single("agreement", F.col("agreement")), single("procurement", procurement), single("organisation", F.col("org_number")), *[single("date", F.col(c)) for c in ("valid_from", "valid_to", "max_extension_to")])
    facts = cut(rows.select("draft", "agreement", F.explode(each).alias("f")).select("draft", "agreement", "f.*").filter("key IS NOT NULL").distinct())
    registered = facts.select("draft", "kind", "key")

    # Which declared agreements a sentence names: by number, or by a name whose first word it has.
    said = found.filter("kind IN ('agreement', 'procurement')").select("draft", "sentence", F.explode(F.concat(F.array("key"), "covers")).alias("agreement"))
    by_number = said.join(rows.select("draft", "agreement").distinct(), ["draft", "agreement"]).select("draft", "sentence", "agreement")
    names = _name_forms(rows)
    # A sentence keeps those of its words that begin a name of its draft.
    firsts = names.groupBy("draft").agg(F.collect_set("word").alias("firsts"))
    worded = sentences.select("draft", "sentence", "said").join(firsts, "draft").select("draft", "sentence", "said", F.explode(F.array_intersect(_words(F.col("said")), "firsts")).alias("word"))
    by_name = worded.join(names, ["draft", "word"]).filter(_says(F.col("said"), F.col("name"))).select("draft", "sentence", "agreement")
    named = cut(by_number.union(by_name).distinct())
    paired = named.join(facts, ["draft", "agreement"]).select("draft", "sentence", "kind", "key")

    # A declared agreement is used if it is named, its organisation is given, or its number stands there as it is spelled.
    org = rows.join(found.filter("kind = 'organisation'").select("draft", F.col("key").alias("org_number")).distinct(), ["draft", "org_number"]).select("draft", "agreement")
    spelled = rows.join(drafts, "draft").filter(F.exists(F.array("number", "agreement_number", "org_number"), lambda s: F.contains(F.lower("text"), F.lower(F.trim(s))))).select("draft", "agreement")
    unused = rows.select("draft", "agreement", "number").distinct().join(named.select("draft", "agreement").union(org).union(spelled).distinct(), ["draft", "agreement"], "left_anti").select("draft", "number", F.lit("unused").alias("problem"))
    about_numbers = cut(wrong_number.union(lacking.select("draft", "number", F.lit("unknown"))).union(unused))

    # What backs a value.
    yes = lambda d, name: d.withColumn(name, F.lit(True))
    quoted = cut(values(cut(scan(passages.filter("text IS NOT NULL")))))
    # What a draft's, or a sentence's, kinds and keys are, in one aggregation and one join; dates a day off the register's are keys as well.
    around = lambda d: d.filter("kind = 'date'").withColumn("key", F.explode(F.transform(F.array(F.lit(-1), F.lit(1)), lambda n: F.date_add(F.to_date("key"), n).cast("string"))))

    def flagged(by: list[str], **sides: DataFrame) -> DataFrame:
        rows = [d.select(*by, *[F.lit(n == name).alias(n) for n in sides]) for name, d in sides.items()]
        return reduce(DataFrame.union, rows).groupBy(*by).agg(*[F.bool_or(n).alias(n) for n in sides])

    v = found.join(yes(named.select("draft", "sentence").distinct(), "named_"), ["draft", "sentence"], "left")
    v = v.join(flagged(["draft", "kind", "key"], registered_=_with_single(registered), elsewhere_=_with_single(_facts(quoted)), near_=around(registered)), ["draft", "kind", "key"], "left")
    v = v.join(flagged(["draft", "sentence", "kind", "key"], paired_=paired, close_=around(paired)), ["draft", "sentence", "kind", "key"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    strict = flag("named_") & F.col("kind").isin("organisation", "date")
    of_others = flag("named_") & flag("registered_") & ~flag("paired_")
    backed = F.when(strict, flag("paired_")).otherwise(flag("registered_")) | (~of_others & flag("elsewhere_")) | (F.col("day").eqNullSafe(today))
    v = v.withColumn("backed_", backed)

    # Dates a day off the register's: of the named agreements if there are any, else of all declared ones.
    v = cut(v.withColumn("off_", F.when(flag("named_"), flag("close_")).otherwise(flag("near_"))))

    # Dates that an offset of their sentence gives from a backed date or today.
    bases = v.filter("backed_ AND day IS NOT NULL").select("draft", "day").union(drafts.select("draft", today.alias("day"))).distinct()
    asked = v.filter("kind = 'date' AND NOT backed_ AND NOT off_ AND day IS NOT NULL").select("draft", "sentence", "day").distinct()
    moves = offsets(sentences.join(asked.select("draft", "sentence").distinct(), ["draft", "sentence"], "left_semi")).join(bases.withColumnRenamed("day", "base"), "draft")
    working = F.col("unit") == "working_days"
    amounts = F.when(working, F.array(*[F.col("sign") * (F.col("amount") + n) for n in (-1, 0, 1)])).otherwise(F.array(F.col("sign") * F.col("amount")))
    moves = moves.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("n", F.explode(amounts)).select("draft", "sentence", "base", "unit", "n")
    reached = _shifted(moves, "base", "n", "to", days).select("draft", "sentence", "unit", F.explode("to").alias("to"))
    slack = F.when(working, F.array(F.lit(0))).otherwise(F.array(*[F.lit(n) for n in (-1, 0, 1)]))
    reached = reached.withColumn("by", F.explode(slack)).select("draft", "sentence", F.date_add("to", F.col("by")).alias("day")).distinct()
    computed = cut(asked.join(reached, ["draft", "sentence", "day"], "left_semi").select("draft", "day").distinct())

    # Calculations, done again; right ones back what they give.
    steps = cut(calculations(scanned, days))
    given = cut(stepped(steps, bases.union(computed)).union(computed).distinct())
    mistaken = steps.filter("NOT ok").select("draft", "at", F.col("written").alias("raw"), "due")

    bad = v.filter("NOT backed_").join(given, ["draft", "day"], "left_anti").join(yes(lacking.select("draft", F.col("agreement").alias("key")), "lacking_"), ["draft", "key"], "left")
    bad = bad.filter(~((F.col("kind") != "date") & flag("lacking_"))).join(mistaken.select("draft", "at"), ["draft", "at"], "left_anti")
    problem = (
        F.when((F.col("kind") == "agreement") & ~F.col("valid"), "malformed")
        .when((F.col("kind") == "organisation") & ~F.col("valid"), "check_digit")
        .when((F.col("kind") == "date") & F.col("day").isNull(), "no_such_day")
        .when(strict, "not_of_named")
        .otherwise("unbacked")
    )
    place, none = F.lit(None).cast("int"), F.lit(None).cast("date")
    about_values = bad.select("draft", F.col("at").cast("int"), "kind", "raw", problem.alias("problem"), none.alias("due"))
    about_steps = mistaken.select("draft", F.col("at").cast("int"), F.lit("date").alias("kind"), "raw", F.lit("calculation").alias("problem"), "due")
    return about_numbers.select("draft", place.alias("at"), F.lit("agreement").alias("kind"), F.col("number").alias("raw"), "problem", none.alias("due")).unionByName(about_values).unionByName(about_steps)


def unbacked(problems: DataFrame) -> DataFrame:
    """(draft, kind, raw): the values that a reservation has to name, each once."""
    return problems.filter("problem NOT IN ('unused', 'calculation')").select("draft", "kind", "raw").distinct()
