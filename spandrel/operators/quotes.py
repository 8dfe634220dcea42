"""Where a quote stands in the pages of its file: the page, and the characters of the page's own text."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages after the cited one that are searched; characters that a part of a quote needs, and how far from the page's edge it may be.
AHEAD, LEAST_PART, EDGE = 10, 24, 200
# Characters that are compared as others.
SAME = dict.fromkeys("‐‑‒–—−", "-") | dict.fromkeys("‘’", "'") | dict.fromkeys("“”„«»", '"') | {"­": "", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _fold(ch: str) -> str:
    """A character as it is compared: no white space, plain quotes and dashes, ligatures and accents apart."""
    return "" if ch.isspace() else SAME[ch] if ch in SAME else unicodedata.normalize("NFD", ch)


def folded(text: str, join_lines: bool = False) -> tuple[str, list[int]]:
    """The folded text, and for each of its characters the place of the one it comes from. join_lines: without hyphens at the ends of lines."""
    out: list[str] = []
    places: list[int] = []
    start = 0
    for line in text.split("\n"):
        last = len(line.rstrip()) - 1
        for i, ch in enumerate(line):
            form = _fold(ch)
            if join_lines and i == last and form == "-":
                continue
            out.append(form)
            places += [start + i] * len(form)
        start += len(line) + 1
    return "".join(out), places


def _plain(text: str, join_lines: bool = False) -> str:
    """The text of folded(), without the places."""
    if join_lines:
        lines = [line.rstrip() for line in text.split("\n")]
        text = "".join(line[:-1] if line and _fold(line[-1]) == "-" else line for line in lines)
    return text.translate({ord(ch): _fold(ch) for ch in set(text)})


def _shared(text: str, needle: str, end: bool) -> int:
    """Characters of the longest beginning of needle, or end of it, that text holds: what is held stays so when it gets shorter."""
    part = lambda n: needle[len(needle) - n :] if end else needle[:n]
    return bisect_right(range(1, len(needle) + 1), 0, key=lambda n: 0 if part(n) in text else 1)


def find(text: str, quote: str) -> tuple[str, int, int]:
    """("full" | "partial" | "none", start, end): where text holds a quote, white space and forms of characters apart.

    Hyphens at ends of lines count, or else don't. A part is the quote's beginning
    at the end of the page, up to a line's end, or its end at the page's start,
    from a line's start: the longer of them. Nothing found has -1 and -1.
    """
    needle = _plain(quote)
    if not needle:
        return "none", -1, -1
    for join_lines in (False, True):
        whole = _plain(text, join_lines)
        at = whole.find(needle)
        if at >= 0:
            places = folded(text, join_lines)[1]
            return "full", places[at], places[at + len(needle) - 1] + 1
    least = min(LEAST_PART, len(needle))
    parts = []
    n, m = _shared(whole, needle, end=False), _shared(whole, needle, end=True)
    if max(n, m) < least:
        return "none", -1, -1
    places = folded(text, True)[1]
    at = whole.rfind(needle[:n]) if n >= least else -1
    if at >= 0 and len(whole) - at - n <= EDGE:
        rest = text[places[at + n - 1] + 1 :].split("\n")[0].strip()
        if not rest or folded(rest)[0] == "-":
            parts.append((n, at))
    at = whole.find(needle[len(needle) - m :]) if m >= least else -1
    if 0 <= at <= EDGE and not text[: places[at]].rpartition("\n")[2].strip():
        parts.append((m, at))
    if not parts:
        return "none", -1, -1
    n, at = max(parts, key=lambda p: p[0])
    return "partial", places[at], places[at + n - 1] + 1


def locate(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (doc, quote, page) with found_on, match, start and end.

    pages: (doc, page, text). The first page from the cited one, up to AHEAD pages
    on, that holds the whole quote; else the first with a part of it; else the
    cited page, with match "none" and -1. A quote meets those pages alone, by
    document and stretch of AHEAD + 1 pages: its pages lie in two stretches at most. Null quotes, pages and texts find nothing; a page that is
    there twice counts as either.
    """
    asked = quotes.filter("quote IS NOT NULL AND page IS NOT NULL").select("doc", "quote", "page").distinct()
    stretch = lambda page: F.floor(page / (AHEAD + 1))
    asked = asked.withColumn("stretch_", F.explode(F.sequence(stretch(F.col("page")), stretch(F.col("page") + AHEAD))))

    @F.pandas_udf("struct<match string, start int, end int>")
    def found(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        rows = [find(t or "", q) for t, q in zip(texts, wanted, strict=True)]
        return pd.DataFrame(rows, columns=["match", "start", "end"])

    paged = pages.select("doc", F.col("page").alias("on"), "text", stretch(F.col("page")).alias("stretch_"))
    met = asked.join(paged, ["doc", "stretch_"]).filter(F.col("on").between(F.col("page"), F.col("page") + AHEAD)).withColumn("x", found("text", "quote")).filter("x.match <> 'none'")
    best = met.groupBy("doc", "quote", "page").agg(F.min(F.struct((F.col("x.match") != "full").alias("part"), "on", F.col("x.start").alias("start"), F.col("x.end").alias("end"))).alias("b"))
    joined = quotes.join(best, ["doc", "quote", "page"], "left")
    match = F.when(F.col("b").isNull(), "none").when(F.col("b.part"), "partial").otherwise("full")
    none = F.lit(-1)
    return joined.select(*quotes.columns, F.coalesce("b.on", "page").alias("found_on"), match.alias("match"), F.coalesce("b.start", none).alias("start"), F.coalesce("b.end", none).alias("end"))
