"""Sections and chunks: page furniture, numbered headings, section trees, and pieces of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.operators import outlines

MAX_CHUNK = 1500
#: Page furniture: short texts on so many pages, and so large a share of them, mostly among the first and last blocks of a page.
MIN_PAGES, PAGE_SHARE, EDGE_BLOCKS, EDGE_SHARE, MAX_FURNITURE = 3, 0.3, 3, 0.8, 150


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def running_headers(blocks: DataFrame) -> DataFrame:
    """(doc, line) of page headers and footers on more than one page; blocks: (doc, position, kind, page, text)."""
    heads = blocks.filter("kind IN ('page_header', 'page_footer') AND page IS NOT NULL").withColumn("line", normalised(F.col("text")))
    return heads.groupBy("doc", "line").agg(F.count_distinct("page").alias("n")).filter("n > 1").select("doc", "line")


def repeated_lines(blocks: DataFrame) -> DataFrame:
    """(doc, line) of short texts on many pages, mostly at the top or bottom of the page."""
    paged = blocks.filter("page IS NOT NULL")
    w = Window.partitionBy("doc", "page")
    placed = paged.withColumn("top", F.row_number().over(w.orderBy("position"))).withColumn("bottom", F.row_number().over(w.orderBy(F.desc("position"))))
    lines = placed.filter(F.length("text") <= MAX_FURNITURE).select("doc", "page", normalised(F.col("text")).alias("line"), ((F.col("top") <= EDGE_BLOCKS) | (F.col("bottom") <= EDGE_BLOCKS)).alias("edge"))
    pages = paged.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    seen = lines.groupBy("doc", "line").agg(F.count_distinct("page").alias("on"), F.count("*").alias("n"), F.count_if("edge").alias("at_edge")).join(pages, "doc")
    needed = F.greatest(F.lit(float(MIN_PAGES)), PAGE_SHARE * F.col("pages"))
    return seen.filter((F.col("pages") >= MIN_PAGES) & (F.col("on") >= needed) & (F.col("at_edge") >= EDGE_SHARE * F.col("n"))).select("doc", "line")


def body_blocks(blocks: DataFrame) -> DataFrame:
    """blocks without running headers, repeated lines and page counters."""
    gone = running_headers(blocks).unionByName(repeated_lines(blocks)).distinct()
    counter = F.col("text").rlike(r"(?iu)^\s*(sida|page)\s+\d+\s*(av|of|/)\s*\d+\s*$|^\s*\d+\s*/\s*\d+\s*$")
    kept = blocks.filter(~counter).withColumn("line", normalised(F.col("text")))
    return kept.join(gone, ["doc", "line"], "left_anti").drop("line")


def contents_lines(lines: DataFrame, around: int = 2) -> DataFrame:
    """lines (doc, position, text) with in_contents: a dotted leader to a page number, or a number and a page with two such lines within two of it."""
    strong = F.col("text").rlike(r"(\.{3,}|…|\t)\s*\d+\s*$")
    weak = F.col("text").rlike(r"^\s*\d+(\.\d+)*\.?\s+\S.*\s\d+\s*$")
    w = Window.partitionBy("doc").orderBy("position").rowsBetween(-around, around)
    return lines.withColumn("near_", F.sum((strong | weak).cast("int")).over(w)).withColumn("in_contents", strong | (weak & (F.col("near_") >= 3))).drop("near_")


def section_tree(sections: DataFrame) -> DataFrame:
    """sections (doc, position, number, title, level) with parent and path: the nearest section before with a smaller level, whose number, if both have one, is a prefix.

    A document's sections are walked in order with a stack, one document at a time.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sections.schema)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position", kind="stable")
        stack: list[tuple] = []
        parents, paths = [], []
        for row in frame.itertuples():
            number = row.number if isinstance(row.number, str) else None
            while stack and not (stack[-1][1] < row.level and (number is None or stack[-1][2] is None or number.startswith(f"{stack[-1][2]}."))):
                stack.pop()
            parents.append(stack[-1][0] if stack else None)
            paths.append([*(stack[-1][3] if stack else []), row.title])
            stack.append((row.position, row.level, number, paths[-1]))
        return frame.assign(parent=pd.array(parents, "Int64"), path=paths)

    return sections.groupBy("doc").applyInPandas(work, f"{fields}, parent long, path array<string>")


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def _long(paragraph: str, size: int) -> Iterator[str]:
    """A paragraph in parts of at most `size` characters: between sentences, or between words."""
    if len(paragraph) <= size:
        yield paragraph
        return
    held = ""
    for sentence in _SENTENCE_END.split(paragraph):
        while len(sentence) > size:
            if held:
                yield held
                held = ""
            cut = sentence.rfind(" ", 0, size)
            cut = cut if cut > 0 else size
            yield sentence[:cut]
            sentence = sentence[cut:].lstrip()
        if held and len(held) + 1 + len(sentence) > size:
            yield held
            held = sentence
        else:
            held = f"{held} {sentence}" if held else sentence
    if held:
        yield held


def pieces(text: str, size: int = MAX_CHUNK) -> list[str]:
    """Paragraphs of a text, packed in order into pieces of at most `size` characters."""
    out: list[str] = []
    for unit in (u for p in text.split("\n\n") for u in _long(p, size)):
        if out and len(out[-1]) + 2 + len(unit) <= size:
            out[-1] += "\n\n" + unit
        else:
            out.append(unit)
    return [x for x in out if x]


def chunks(sections: DataFrame, size: int = MAX_CHUNK) -> DataFrame:
    """sections (text, ...) with one row, numbered by chunk, for each piece of its text."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t or "", size))

    return sections.select(*[c for c in sections.columns if c != "text"], F.posexplode(cut("text")).alias("chunk", "text"))


def with_context(chunked: DataFrame, agreement: Column, document: Column, path: Column) -> DataFrame:
    """chunked with context_header, and the text that is indexed."""
    header = F.concat_ws(" › ", agreement, document, path)
    return chunked.withColumn("context_header", header).withColumn("embedded", F.concat("context_header", F.lit("\n\n"), "text"))


# Choosing headings


def outline(lines: DataFrame) -> DataFrame:
    """Numbered headings (doc, position, number, title, level) among lines (doc, position, text), less those of the contents.

    The chain of headings with the best scores, as outlines.best_chain() has it; numbers that the contents list count for more.
    """
    form = r"^\s*(\d+(?:\.\d+)*)\.?\s+(\p{Lu}.*)$"
    marked = contents_lines(lines)
    number = F.regexp_extract("text", form, 1)
    title = F.trim(F.regexp_replace(F.regexp_extract("text", form, 2), r"[\s.…]*\d*\s*$", ""))
    score = 1.0 + F.when((F.length("text") <= 100) & ~F.col("text").rlike(r"\.\s*$"), 0.5).otherwise(0.0)
    found = marked.filter(~F.col("in_contents") & F.col("text").rlike(form) & ~F.col("text").rlike(r"[,;]\s*$")).select("doc", "position", number.alias("number"), title.alias("title"), score.alias("score"))
    # Sections are numbered from 1, and larger parts are amounts.
    parts = F.transform(F.split("number", r"\."), lambda x: x.try_cast("int"))
    found = found.filter(F.forall(parts, lambda x: F.coalesce(x.between(1, 200), F.lit(False))))
    contents = marked.filter("in_contents").select("doc", F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)", 1).alias("number")).distinct().withColumn("listed", F.lit(True))
    listed = found.join(contents, ["doc", "number"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return outlines.choose(listed.withColumn("score", F.col("score") + F.when(F.col("listed"), outlines.LISTED).otherwise(0.0)))


def contents_missing(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, number) of contents lines without a section."""
    listed = contents_lines(lines).filter("in_contents").select("doc", F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)", 1).alias("number")).filter("number <> ''").distinct()
    return listed.join(sections.select("doc", "number"), ["doc", "number"], "left_anti")
