"""Web pages of agreements: links of an index, facts and documents of a page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_query(url: Column) -> Column:
    return F.element_at(F.split(url, r"[?#]"), 1)


def absolute(href: Column, base: Column) -> Column:
    """A link's address, from the page's."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), href))


def links(pages: DataFrame, containing: str = "") -> DataFrame:
    """(page_id, place, url): each address once, in order of its first link that contains a text; pages: (page_id, url, html)."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    each = pages.select("page_id", F.col("url").alias("base"), F.posexplode(hrefs).alias("place", "href")).filter(F.col("href").contains(containing))
    return each.select("page_id", "place", without_query(absolute(F.col("href"), F.col("base"))).alias("url")).groupBy("page_id", "url").agg(F.min("place").alias("place"))


def heading(source: Column) -> Column:
    """The text of the first h1, with markup taken out."""
    inner = F.regexp_extract(source, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>", " "), r"\s+", " "))


class _Page(HTMLParser):
    """Facts after their headings, and rows of the document table: (label, title, href)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.facts: dict[str, str] = {}
        self.rows: list[tuple[str | None, str, str]] = []
        self._into: list[str] | None = None
        self._fact: str | None = None
        self._label: str | None = None
        self._kind = self._href = ""
        self._text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        classes = at.get("class", "").split()
        if tag == "h2" and "fakta-rubrik" in classes:
            self._kind, self._text = "fact", []
        elif tag == "div" and "tbl-label" in classes:
            self._kind, self._text = "label", []
        elif tag == "div" and "tbl-row" in classes:
            self._kind = "row"
        elif tag == "a" and self._kind == "row" and "href" in at:
            self._href, self._text = at["href"], []

    def handle_data(self, data: str) -> None:
        if self._kind:
            self._text.append(data)
        elif self._fact and data.strip():
            self.facts.setdefault(self._fact, " ".join(data.split()))
            self._fact = None

    def handle_endtag(self, tag: str) -> None:
        said = " ".join("".join(self._text).split())
        if tag == "h2" and self._kind == "fact":
            self._fact, self._kind = said, ""
        elif tag == "div" and self._kind == "label":
            self._label, self._kind = said or self._label, ""
        elif tag == "a" and self._kind == "row" and self._href:
            self.rows.append((self._label, said, self._href))
            self._href = ""
        elif tag == "div" and self._kind == "row":
            self._kind = ""


def agreement_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, facts map, documents array<struct<category, title, href>>) of agreement pages; a document without a label has the last one before it."""

    @F.pandas_udf("struct<facts:map<string,string>,documents:array<struct<category:string,title:string,href:string>>>")
    def parsed(sources: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in sources:
            facts, documents = [], []
            for source in part:
                page = _Page()
                page.feed(source or "")
                facts.append(page.facts)
                documents.append([{"category": c, "title": t, "href": h} for c, t, h in page.rows])
            yield pd.DataFrame({"facts": facts, "documents": documents})

    return pages.select("page_id", "url", heading(F.col("html")).alias("title"), parsed("html").alias("p")).select("page_id", "url", "title", "p.facts", "p.documents")


def select_pages(pages: DataFrame, numbers: list[str]) -> DataFrame:
    """Pages with any of the procurement numbers."""
    return pages.filter(F.arrays_overlap("procurement_numbers", F.array(*[F.lit(n) for n in numbers])))


def carried_forward(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """rows with the last value of column at or before each."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def needs_ocr(char_count: Column, image_share: Column) -> Column:
    """Whether a page of a scanned file has too little text for its pictures."""
    return (char_count < 50) & (image_share >= 0.5)
