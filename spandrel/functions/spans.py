"""Where a pattern matches in a text: Spark's regular expressions give what was found, not its place.

A text is cut at the matches as well, and places are added up from the lengths of
what lies between. Positions count characters from 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,raw:string>"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, raw>>: the matches in order, none for a null text. The pattern may not match an empty text.

    One fold over the matches; its cost grows with the square of their number in one text.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("before"), _all(text, pattern).alias("raw"))

    # try_element_at: the array is empty at first.
    def step(found: Column, x: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        start = F.coalesce(last["end"], F.lit(0)) + F.length(x["before"])
        return F.concat(found, F.array(F.struct(start.alias("start"), (start + F.length(x["raw"])).alias("end"), x["raw"].alias("raw"))))

    matched = F.filter(pairs, lambda x: x["raw"].isNotNull())
    none = F.array().cast(f"array<{SPAN}>")
    # F.split compiles the pattern for every text anew: only those that have a match are cut.
    return F.when(text.rlike(pattern), F.aggregate(matched, none, step)).otherwise(none)


def claimed(text: Column, pattern: str, where: Callable[[Column], Column] | None = None, fill: str = " ") -> Column:
    """The text with its matches (those for which where(raw) holds) written over by as many fill characters, so that later patterns don't read them and places stay as they are."""
    found = _all(text, pattern)

    def over(raw: Column) -> Column:
        blank = F.repeat(F.lit(fill), F.length(raw))
        return F.when(where(raw), blank).otherwise(raw) if where else blank

    written = F.array_join(F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("before"), found.alias("raw")), lambda x: F.concat(x["before"], F.coalesce(over(x["raw"]), F.lit("")))), "")
    return F.when(text.rlike(pattern), written).otherwise(text)


def between(text: Column, start: Column, end: Column) -> Column:
    """The characters from start up to, not including, end."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
