"""Facts about periods of agreements in the blocks of their texts: dates, lengths, extensions, signatures, fields left open.

Each rule is a pattern; a fact is (doc, position, rule, kind, value, scope), dates
in ISO form and lengths in months. Invalid dates give no fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import dates, text
from spandrel.operators.references import MONTHS

_DAY = rf"\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+\d{{4}}"
_NUMBER = rf"(?:\d+|{'|'.join(sorted(text.number_words(), key=len, reverse=True))})"
_LENGTH = rf"{_NUMBER}(?:\s*\(\d+\))?\s*(?:månad(?:er)?|år|months?|years?)\b"
_DASH = r"\s*(?:–|—|-|till(?: och med)?|t\.o\.m\.|to|until)\s*"
_FLAGS = "(?iu)"
#: Blocks that a period on a cover may be spread over.
COVER = 3
START, END, PLANNED, LENGTH, EXTENSION, SIGNED, OPEN = "start", "end", "planned_start", "months", "extension_months", "signed_on", "placeholder"
#: Rules of one value: (rule, kind, pattern with the value as group 1).
_SINGLE = (
    ("P2", START, rf"(?:avtal\w*|agreement)\b[^.\n]{{0,80}}?(?:träder i kraft|gäller från(?: och med)?|enters into force(?: on)?|is valid from)\s+(?:den\s+)?({_DAY})"),
    ("P3", END, rf"(?:längst till(?: och med)?|senast|upphör(?: att gälla)?|no longer than until|ends(?: on)?)\s+(?:den\s+)?({_DAY})"),
    ("P4", START, rf"(?:tidigast(?: från)?|no earlier than)\s+(?:den\s+)?({_DAY})"),
    ("P9", PLANNED, rf"(?:planerad\w* (?:avtals)?start\w*|beräknad\w* start\w*|planned start)\s*:?\s+(?:den\s+)?({_DAY})"),
)
#: Rules of two dates: (rule, pattern with them as groups 1 and 2).
_RANGES = (
    ("P5", rf"(?:från(?: och med)?|fr\.o\.m\.|from)\s+(?:den\s+)?({_DAY})\s+(?:till(?: och med)?|t\.o\.m\.|to|until)\s+(?:den\s+)?({_DAY})"),
    ("P6", rf"(?:avtalsperiod\w*|avtalstid\w*|giltighet\w*|period of validity|term)\b[^.\n]{{0,40}}?({_DAY}){_DASH}({_DAY})"),
)
_PERIOD_LENGTH = rf"(?:avtalsperiod\w*|avtalstid\w*|löptid\w*|gäller i|term of|runs for)\b[^.\n]{{0,40}}?({_LENGTH})"
_EXTENDED = rf"(?:förläng\w*|extend\w*|extension\w*)[^.]*?{_LENGTH}[^.]*"
_COVER = rf"(?:giltig|gäller|valid)\b[^.]{{0,60}}?({_DAY}){_DASH}({_DAY})"
_FIELD = r"(?:[ÅåXx]{2,4}-[MmXx]{2}-[DdXx]{2}|\[datum\]|\[date\])"
_SIGNED = r"(?<![0-9-])(\d{4}-\d{2}-\d{2})\s+\d{2}:\d{2}(?::\d{2})?"
_AREA = r"(?:delområde|sub-area)\s+([\p{L}\p{N}][\p{L}\p{N} -]{0,60}?)(?=\s*[:,.;\n]|\s+(?:gäller|är|is|from|från)\b)"


def day_of(value: Column) -> Column:
    """A date from its ISO form or with the month's name; null for what isn't one."""
    named = rf"{_FLAGS}^(\d{{1,2}})\s+(\p{{L}}+)\s+(\d{{4}})$"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(value, named, 2)))
    spelled = F.concat_ws("-", F.regexp_extract(value, named, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(value, named, 1), 2, "0"))
    return F.coalesce(dates.iso_date(value), F.when(value.rlike(named), F.try_to_date(spelled, "yyyy-MM-dd")))


def months_of(length: Column) -> Column:
    """A length in months: digits win over words, a year has twelve."""
    digits = F.regexp_extract(length, r"(\d+)", 1)
    number = F.coalesce(F.when(digits != "", digits.cast("int")), text.number_of(F.regexp_extract(length, r"^(\p{L}+)", 1)))
    return number * F.when(length.rlike(rf"{_FLAGS}(?:år|years?)$"), 12).otherwise(1)


def _fact(rule: str, kind: str, value: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))


def _all(source: str | Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(source, F.lit(_FLAGS + pattern), F.lit(group))


def _pairs(source: str | Column, rule: str, pattern: str) -> Column:
    found = F.transform(F.arrays_zip(_all(source, pattern, 1).alias("a"), _all(source, pattern, 2).alias("b")), lambda x: F.struct(day_of(x["a"]).alias("a"), day_of(x["b"]).alias("b")))
    good = F.filter(found, lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] <= x["b"]))
    return F.flatten(F.transform(good, lambda x: F.array(_fact(rule, START, x["a"]), _fact(rule, END, x["b"]))))


def _days(rule: str, kind: str, pattern: str) -> Column:
    return F.filter(F.transform(_all("text", pattern, 1), lambda d: _fact(rule, kind, day_of(d))), lambda x: x["value"].isNotNull())


def longest_extension(source: str | Column = "text") -> Column:
    """array<int>: per sentence that speaks of an extension, the longest of the lengths in it, in months."""
    return F.transform(_all(source, rf"({_EXTENDED})", 1), lambda s: F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"{_FLAGS}({_LENGTH})"), F.lit(1)), months_of)))


def facts(blocks: DataFrame) -> DataFrame:
    """(doc, position, rule, kind, value, scope, statement) of blocks (doc, position, text, is_cover, page, certificate_page).

    P1 reads covers over the block and the next two; P11 reads signatures on pages
    from the certificate on. scope is the last sub-area named in the block.
    Facts of one block and scope are one statement; statements are numbered per document.
    """
    w = Window.partitionBy("doc").orderBy("position")
    after = [F.lead("text", i).over(w) for i in range(1, COVER)]
    read = blocks.withColumn("cover", F.concat_ws("\n", "text", *after)).withColumn("scope", F.element_at(F.concat(F.array(F.lit(None).cast("string")), _all("text", _AREA, 1)), -1))
    single = [_days(rule, kind, pattern) for rule, kind, pattern in _SINGLE]
    ranges = [_pairs("text", rule, p) for rule, p in _RANGES]
    own = F.regexp_instr("cover", F.lit(_FLAGS + _COVER)) <= F.length("text")  # starts in this block
    cover = F.when(F.col("is_cover") & own, F.slice(_pairs("cover", "P1", _COVER), 1, 2)).otherwise(F.array().cast("array<struct<rule:string,kind:string,value:string>>"))
    lengths = F.transform(_all("text", _PERIOD_LENGTH, 1), lambda x: _fact("P7", LENGTH, months_of(x)))
    extended = F.transform(longest_extension(), lambda n: _fact("P8", EXTENSION, n))
    fields = F.transform(_all("text", f"({_FIELD})", 1), lambda _: _fact("P10", OPEN, F.lit("date")))
    signed = F.when(F.col("page") >= F.col("certificate_page"), _days("P11", SIGNED, _SIGNED)).otherwise(F.array().cast("array<struct<rule:string,kind:string,value:string>>"))
    found = read.select("doc", "position", "scope", F.explode(F.array_distinct(F.concat(cover, *single, *ranges, lengths, extended, fields, signed))).alias("f"))
    return found.select("doc", "position", "f.*", "scope", F.dense_rank().over(Window.partitionBy("doc").orderBy("position", "scope")).alias("statement"))


def sentences(source: Column) -> Column:
    """array<string>: sentences of a text; a full stop after an abbreviation or a single letter ends none."""
    # Abbreviations.
    short = "t\\.ex|bl\\.a|dvs|fr\\.o\\.m|t\\.o\\.m|s\\.k|kl|nr|st|kap|ca|resp|jfr|e\\.g|i\\.e|no"
    marked = F.regexp_replace(source, rf"(?iu)\b((?:{short})|\p{{L}})\.(?=\s)", "$1\u0001")
    return F.transform(F.filter(F.split(marked, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}])"), lambda s: F.trim(s) != ""), lambda s: F.replace(F.trim(s), F.lit("\u0001"), F.lit(".")))
