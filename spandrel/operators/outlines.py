"""Outlines: what a heading may follow, the best chain of headings, numbers that contents leave out, and list markers.

Window functions and folds over short arrays do what looks at neighbours. The
search for the best chain and the runs of list markers are sequential in one
document, and read sorted rows in Arrow batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the outline search.
GAP, MOST_GAPS, SKIPPED, MOST_SKIPPED, DEEP_START, LISTED = 0.75, 3, 1.0, 2, 1.0, 1.0
#: Candidates that a chain may skip between two headings.
LOOK_BACK = 400
ALIKE = 0.75


def step_cost(before: tuple[int, ...], number: tuple[int, ...], listed: bool = False) -> float | None:
    """What it costs a heading to follow another, or None if it can't.

    It has to go on at some level: as the first child, or with a later number at
    the same or a higher level. Missing numbers and levels without a heading of
    their own cost; a level without a heading starts at 1, unless the number is
    listed in the document's contents.
    """
    at = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(before, number, strict=False))))
    below = number[at + 1 :]
    skipped_over = sum(below) - len(below)
    if at == len(number) or len(below) > MOST_SKIPPED or (skipped_over and not listed):
        return None
    gap = number[at] - 1 - (before[at] if at < len(before) else 0)
    return None if gap < 0 else GAP * min(gap + skipped_over, MOST_GAPS) + SKIPPED * len(below)


def step_cost_column(before: Column, number: Column, listed: Column | None = None) -> Column:
    """step_cost() of arrays; null if the step can't be taken or either is null."""
    listed = F.lit(False) if listed is None else listed
    n = F.least(F.size(before), F.size(number))
    equal = F.zip_with(F.slice(before, F.lit(1), n), F.slice(number, F.lit(1), n), lambda a, b: a == b)
    at = F.coalesce(F.nullif(F.array_position(equal, F.lit(False)), F.lit(0)) - 1, n).cast("int")
    below = F.slice(number, at + 2, F.size(number))
    over = F.aggregate(below, F.lit(0), lambda s, x: s + x.cast("int") - 1)
    gap = F.try_element_at(number, at + 1) - 1 - F.coalesce(F.try_element_at(before, at + 1), F.lit(0))
    allowed = before.isNotNull() & number.isNotNull() & (at < F.size(number)) & (F.size(below) <= MOST_SKIPPED) & ((over == 0) | listed) & (gap >= 0)
    return F.when(allowed, GAP * F.least(gap + over, F.lit(MOST_GAPS)) + SKIPPED * F.size(below))


def best_chain(numbers: list[tuple[int, ...]], scores: list[float], listed: list[bool] | None = None) -> list[int]:
    """Indices of the chain of headings with the largest sum of scores less costs; of equal ones the first found.

    If it leaves out numbers that the contents list, the chain with the most
    listed numbers is taken instead, if it has more of them.
    """
    listed = listed or [False] * len(numbers)

    def search(bonus: float) -> list[int]:
        worth = [s + bonus * on for s, on in zip(scores, listed, strict=True)]
        value, link = [], []
        for i, number in enumerate(numbers):
            ways = [(worth[i] - DEEP_START * (len(number) - 1), -1)]
            for j in range(max(0, i - LOOK_BACK), i):
                cost = step_cost(numbers[j], number, listed[i])
                if cost is not None:
                    ways.append((value[j] + worth[i] - cost, j))
            best = max(ways, key=lambda w: w[0])
            value.append(best[0])
            link.append(best[1])
        chain, at = [], max(range(len(value)), key=value.__getitem__, default=-1)
        while at >= 0:
            chain.append(at)
            at = link[at]
        return chain[::-1]

    count = lambda chain: len({numbers[i] for i in chain if listed[i]})
    chain = search(0.0)
    if count(chain) < len({n for n, on in zip(numbers, listed, strict=True) if on}):
        other = search(1.0 + sum(scores))
        chain = other if count(other) > count(chain) else chain
    return chain


def choose(candidates: DataFrame) -> DataFrame:
    """(doc, position, number, title, level) of the best chain of each document's candidates (doc, position, number, title, score, listed); number as text."""
    doc = candidates.schema["doc"].dataType.simpleString()
    columns = ("doc", "position", "number", "title", "score", "listed")

    def work(rows: list[tuple]) -> list[tuple]:
        numbers = [tuple(map(int, r[2].split("."))) for r in rows]
        kept = best_chain(numbers, [r[4] for r in rows], [r[5] for r in rows])
        return [(*rows[i][:4], len(numbers[i])) for i in kept]

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of sorted rows, one after another; one may go on in the next batch."""
        rows: list[tuple] = []
        names, types = (*columns[:4], "level"), None
        for batch in batches:
            types, found = [*(batch.column(i).type for i in range(4)), pa.int64()], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    found += work(rows)
                    rows = []
                rows.append(row)
            yield _batch(found, names, types)
        if rows:
            yield _batch(work(rows), names, types)

    ordered = candidates.select("doc", F.col("position").cast("long").alias("position"), *columns[2:]).repartition("doc").sortWithinPartitions("doc", "position")
    return ordered.mapInArrow(chains, f"doc {doc}, position long, number string, title string, level long")


def _batch(rows: list[tuple], names: tuple[str, ...], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=list(names))


# Numbers that a table of contents doesn't print


def _back(last: Column, steps: Column) -> Column:
    """The number so many steps before last in an outline without gaps: 4.4, 4.3, 4.2, 4.1, 4, 3; null below 1.

    A fold over the levels from the deepest: within a level steps are taken off
    its number, and what is left goes on with the parent.
    """
    start = F.struct(steps.cast("int").alias("left"), F.lit(None).cast("array<int>").alias("found"))

    def level(state: Column, depth: Column) -> Column:
        part = F.element_at(last, depth)
        here = state["found"].isNull() & (state["left"] < part)
        found = F.when(here, F.concat(F.slice(last, F.lit(1), depth - 1), F.array(part - state["left"]))).otherwise(state["found"])
        return F.struct((state["left"] - part).alias("left"), found.alias("found"))

    return F.when(F.size(last) > 0, F.aggregate(F.sequence(F.size(last), F.lit(1), F.lit(-1)), start, level)["found"])


def _after(before: Column, level: Column) -> Column:
    """The first number of a level after another one; null if levels between them are missing."""
    same = F.concat(F.slice(before, F.lit(1), F.greatest(level - 1, F.lit(0))), F.array(F.try_element_at(before, level) + 1))
    return F.when(F.size(before) >= level, same).when(F.size(before) == level - 1, F.concat(before, F.array(F.lit(1))))


def infer_numbers(entries: DataFrame) -> DataFrame:
    """entries (doc, position, number array<int>, ...) of contents with numbers for those printed without one, where both neighbours of a run agree on them.

    A run before a number with a level below counts back from that number's
    parent. The level of a document's first run that fits so is one whose numbers
    aren't printed: other runs count on at that level from what precedes them. A
    run is numbered only if its first number follows the one before it, and the
    one after follows its last, without a gap. Documents without numbers, and
    runs at the beginning, stay as they are; positions are distinct in a document.
    """
    w, back = Window.partitionBy("doc").orderBy("position"), Window.partitionBy("doc").orderBy(F.desc("position"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.struct(*[F.col(f"`{c}`") for c in entries.columns]).alias("row_")
    runs = entries.select("doc", "position", F.col("number").cast("array<int>").alias("number"), whole).withColumns({"island_": F.count("number").over(upto), "before_": F.last("number", ignorenulls=True).over(upto), "after_": F.last("number", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)), "open_": F.col("number").isNull()})
    of_run = Window.partitionBy("doc", "island_", "open_")
    runs = runs.withColumns({"size_": F.count("*").over(of_run), "at_": F.row_number().over(of_run.orderBy("position"))})
    free = lambda cost: F.coalesce(cost == 0, F.lit(False))

    def fits(first: Column, last: Column) -> Column:
        return free(step_cost_column(F.col("before_"), first)) & (F.col("after_").isNull() | free(step_cost_column(last, F.col("after_"))))

    parent = F.when(F.size("after_") > 1, F.slice("after_", F.lit(1), F.size("after_") - 1))
    runs = runs.withColumns({"last_": parent, "first_": _back(parent, F.col("size_") - 1)})
    runs = runs.withColumn("counted_", F.col("open_") & F.col("before_").isNotNull() & F.coalesce(fits(F.col("first_"), F.col("last_")), F.lit(False)))
    level = runs.filter("counted_").groupBy("doc").agg(F.min_by(F.size("last_"), "position").alias("level_"))
    runs = runs.join(level, "doc", "left")
    runs = runs.withColumn("next_", F.when(F.col("level_").isNotNull() & F.col("before_").isNotNull(), _after(F.col("before_"), F.col("level_"))))
    moved = lambda n: F.concat(F.slice("next_", F.lit(1), F.size("next_") - 1), F.array(F.element_at("next_", -1) + n.cast("int")))
    on = F.col("open_") & F.col("next_").isNotNull() & F.coalesce(fits(F.col("next_"), moved(F.col("size_") - 1)), F.lit(False))
    found = F.when(~F.col("open_"), F.col("number")).when(F.col("counted_"), _back(F.col("last_"), F.col("size_") - F.col("at_"))).when(on, moved(F.col("at_") - 1))
    return runs.select(*[found.alias("number") if c == "number" else F.col(f"row_.`{c}`") for c in entries.columns])


# List markers, and the questions of a log

# Markers at the end and at the beginning of list items, and the first lines of a log's entries.
TRAILING = r"(?s)^(.*\S)\s+([0-9]{1,3}|[a-z])([.)])$"
BULLET = r"(?s)^(.*\S)\s+([·•▪◦●])$"
LEADING = r"^(?:\(?(?:[0-9]{1,3}|[a-zA-Z])[.)]|[·•▪◦●\-–])\s"
QUESTION = r"^(?:([0-9]{1,4}) )?(Publik fråga|Privat fråga|Publikt informationsmeddelande)(?: ([0-9]{1,4}))?$"
LEAST_QUESTIONS = 3


def markers_first(blocks: DataFrame) -> DataFrame:
    """blocks (doc, position, kind, text, ...) with list markers that stand at an item's end moved to its front.

    A number or letter is a marker if it lies in a run 1, 2, 3 ... or a, b, c ...
    of two or more; the alphabets are apart, so that letters within a numbered
    item don't end its run, and what is out of turn is passed over. A bullet at
    the end of a list item always is one. Items that begin with a marker keep it.
    """
    kind = F.col("kind").isin("list_item", "heading") & ~F.col("text").rlike(LEADING)
    bullet = kind & (F.col("kind") == "list_item") & F.col("text").rlike(BULLET)
    marker = F.when(kind & ~bullet, F.nullif(F.regexp_extract("text", TRAILING, 2), F.lit("")))
    place = F.coalesce(marker.try_cast("int"), F.ascii(marker) - 96)
    items = blocks.select("doc", "position", marker.alias("marker"), place.alias("place")).filter("marker IS NOT NULL").withColumn("digits", F.col("marker").rlike("^[0-9]"))
    types = {c: items.schema[c].dataType.simpleString() for c in ("doc", "position")}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The items in a run of two or more: each is one more than the last that was taken, or a 1 that begins anew."""
        list_, last, head = None, None, None
        for batch in batches:
            kept = []
            for doc, digits, position, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, digits) != list_:
                    list_, last, head = (doc, digits), None, None
                if last is not None and place == last + 1:
                    kept += [(doc, position)] if head is None else [head, (doc, position)]
                    last, head = place, None
                elif place == 1:
                    last, head = 1, (doc, position)
            yield _batch(kept, ("doc", "position"), (batch.column(0).type, batch.column(2).type))

    # Lists are read one after another, in pieces of any size.
    ordered = items.select("doc", "digits", "position", "place").repartition("doc", "digits").sortWithinPartitions("doc", "digits", "position")
    moved = ordered.mapInArrow(runs, f"doc {types['doc']}, position {types['position']}").distinct().withColumn("moved_", F.lit(True))
    met = blocks.join(moved, ["doc", "position"], "left")
    front = lambda form, dot: F.concat(F.regexp_extract("text", form, 2), F.regexp_extract("text", form, 3) if dot else F.lit(""), F.lit(" "), F.regexp_extract("text", form, 1))
    return met.withColumn("text", F.when(bullet, front(BULLET, False)).when(F.col("moved_"), front(TRAILING, True)).otherwise(F.col("text"))).select(blocks.columns)


def question_headings(blocks: DataFrame) -> DataFrame:
    """(doc, position, number, title, level) of the entries of question logs: documents with at least LEAST_QUESTIONS blocks (doc, position, text) whose first line says so."""
    line = F.trim(F.regexp_replace(F.substring_index(F.trim(F.regexp_replace("text", r"^\s+", "")), "\n", 1), r"\s+", " "))
    found = blocks.withColumn("line_", line).filter(F.col("line_").rlike(QUESTION))
    number = F.coalesce(F.nullif(F.regexp_extract("line_", QUESTION, 1), F.lit("")), F.nullif(F.regexp_extract("line_", QUESTION, 3), F.lit("")))
    counted = found.withColumn("n_", F.count("*").over(Window.partitionBy("doc"))).filter(F.col("n_") >= LEAST_QUESTIONS)
    return counted.select("doc", "position", number.alias("number"), F.regexp_extract("line_", QUESTION, 2).alias("title"), F.lit(1).cast("long").alias("level"))


# Uploads

MOST_CHARACTERS = 12_000
SEPARATORS = ("\n\n", "\n", " ")


def cut_late(text: str, most: int) -> list[str]:
    """A text in pieces of at most so many characters, each cut at the largest separator that its second half has, as late as fits."""
    out, rest = [], text.strip()
    while len(rest) > most:
        places = (rest.rfind(s, most // 2, most) for s in SEPARATORS)
        at = next((p for p in places if p > 0), most)
        out.append(rest[:at].rstrip())
        rest = rest[at:].lstrip()
    return [*out, rest] if rest else out


def split_upload(sections: DataFrame, lines: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """sections (file, position, title, text, page_start, page_end, ...) cut into pieces of at most `most` characters: piece, pieces, title, text and page.

    A piece's title says which of how many it is. Its page is the first, from the
    page of the piece before, on which lines (file, page, text) have its first
    line, up to the section's last page; else that of the piece before. A null
    text has no pieces.
    """

    @F.pandas_udf("array<string>")
    def cut_(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_late(t or "", most))

    key = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    rest = [c for c in sections.columns if c not in ("text", "title", "file", "position", "page_start", "page_end")]
    cut = sections.withColumn("cut_", cut_("text"))
    pieces = cut.select(*[c for c in sections.columns if c != "text"], F.size("cut_").alias("pieces"), F.posexplode("cut_").alias("piece", "text")).withColumn("piece", F.col("piece") + 1)
    asked = pieces.filter("piece > 1").select("file", "position", "piece", "page_start", "page_end", key(F.substring_index("text", "\n", 1)).alias("line"))
    placed = lines.filter("page IS NOT NULL").select("file", "page", key(F.col("text")).alias("line")).distinct()
    met = asked.join(placed, ["file", "line"]).filter(F.col("page").between(F.col("page_start"), F.coalesce("page_end", F.lit(2**31 - 1))))
    pages = met.groupBy("file", "position", "piece").agg(F.array_sort(F.collect_set("page")).alias("on"))  # as many as a section has pages
    per = pieces.select("file", "position", "piece", "page_start", "page_end").join(pages, ["file", "position", "piece"], "left")
    row = F.struct("piece", "on", "page_start", "page_end")
    ordered = per.groupBy("file", "position").agg(F.array_sort(F.collect_list(row)).alias("all"))  # the pieces of one section

    def follow(state: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(state, F.lit(-1)), x["page_start"])
        upto = F.coalesce(x["page_end"], last)
        hit = F.try_element_at(F.filter(x["on"], lambda p: (p >= last) & (p <= upto)), F.lit(1))
        return F.concat(state, F.array(F.coalesce(hit, last)))

    kind = dict(sections.dtypes)["page_start"]
    walked = ordered.select("file", "position", F.posexplode(F.aggregate("all", F.array().cast(f"array<{kind}>"), follow)).alias("piece", "page")).withColumn("piece", F.col("piece") + 1)
    title = F.when(F.col("pieces") > 1, F.format_string("%s (del %d av %d)", "title", "piece", "pieces")).otherwise(F.col("title"))
    return pieces.drop("page_start", "page_end").withColumn("title", title).join(walked, ["file", "position", "piece"]).select("file", "position", "piece", "pieces", "title", "text", "page", *rest)


# Texts that are alike


def _ratio(pairs: pd.DataFrame) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(pairs.iloc[:, 0], pairs.iloc[:, 1], strict=True)], dtype="float64")


def matching_ratio(first: Column, second: Column) -> Column:
    """Twice the characters in matching blocks, longest first, over the characters of both."""
    return F.pandas_udf(lambda a, b: _ratio(pd.concat([a, b], axis=1)), "double")(first, second)


def heading_words(text: Column) -> Column:
    """A title's or phrase's words in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def heading_similarity(pairs: DataFrame, phrase: str = "phrase", title: str = "title") -> DataFrame:
    """pairs with similarity: the matching ratio of the first words of both, as many as the shorter has; 0 if either has none."""
    a, b = heading_words(F.col(title)), heading_words(F.col(phrase))
    n = F.least(F.size(a), F.size(b))
    start = lambda w: F.array_join(F.slice(w, F.lit(1), n), " ")
    distinct = pairs.select(phrase, title).distinct().withColumns({"a_": start(a), "b_": start(b)})
    rated = distinct.withColumn("similarity", F.when(F.col("a_") == F.col("b_"), (F.col("a_") != "").cast("double")).otherwise(matching_ratio(F.col("a_"), F.col("b_")))).drop("a_", "b_")
    return pairs.join(rated, [phrase, title])


def _grams(text: Column, singles: Column) -> Column:
    """Pairs of neighbouring characters; and single ones where asked for."""
    n = F.length(text)
    pairs = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(2)))
    return F.array_distinct(F.concat(pairs, F.when(singles, F.split(text, "")).otherwise(F.array().cast("array<string>"))))


def close_texts(asked: DataFrame, known: DataFrame, least: float = ALIKE) -> DataFrame:
    """(asked, known, ratio) of texts whose matching ratio is at least `least`, which is 0.75 or more.

    Such texts share two neighbouring characters if they have more than eight
    together: blocks of single characters would leave more gaps than a quarter of
    both has characters. Shorter ones share a character. They meet by that, and
    the ratio decides.
    """
    if least < ALIKE:
        raise ValueError("texts less alike need not share two neighbouring characters")
    short = F.length("asked") <= 7
    left = asked.select("asked").distinct().withColumn("g_", F.explode(_grams(F.col("asked"), short)))
    right = known.select("known").distinct().withColumn("g_", F.explode(_grams(F.col("known"), F.lit(True))))
    met = left.join(right, "g_").select("asked", "known").distinct()
    # No more can match than the shorter has.
    possible = 2 * F.least(F.length("asked"), F.length("known")) >= least * (F.length("asked") + F.length("known"))
    return met.filter(possible).withColumn("ratio", matching_ratio(F.col("known"), F.col("asked"))).filter(F.col("ratio") >= least)


def guess_areas(asked: DataFrame, areas: DataFrame, top: int = 3) -> DataFrame:
    """(asked, rank, area): what names that aren't areas (area) may mean, at most `top` each.

    First the areas that hold the name, or that it holds: those that start alike,
    then those with a word that starts so. Without any, those that are alike in
    spelling; without any again, those with a word that is. Names that are areas,
    whatever their case, and empty ones get none.
    """
    known = areas.select("area", F.lower("area").alias("known")).filter("known <> ''").groupBy("known").agg(F.max("area").alias("area"))
    names = asked.select("asked", F.lower(F.trim("asked")).alias("name")).filter("name <> ''").distinct()
    names = names.join(known.select(F.col("known").alias("name")), "name", "left_anti")
    wanted = names.select(F.col("name").alias("asked")).distinct()
    words = known.select(F.explode(F.array_distinct(F.filter(F.split("known", r"\s+"), lambda w: w != ""))).alias("word"), "area").groupBy("word").agg(F.max("area").alias("area"))

    grams = lambda c: F.explode(_grams(F.col(c), F.lit(True)))
    whole = wanted.withColumn("g_", F.explode(_grams(F.col("asked"), F.length("asked") == 1))).join(known.withColumn("g_", grams("known")), "g_").select("asked", "known", "area").distinct()
    # A short area may lie within a name that shares no pair with it.
    single = known.filter(F.length("known") == 1).withColumn("g_", F.col("known")).join(wanted.withColumn("g_", grams("asked")), "g_").select("asked", "known", "area")
    inside = whole.unionByName(single).filter(F.contains("known", F.col("asked")) | F.contains("asked", F.col("known"))).distinct()
    starts = F.startswith(F.col("known"), F.col("asked")) | F.startswith(F.col("asked"), F.col("known"))
    by_word = F.exists(F.split("known", r"\s+"), lambda w: F.startswith(w, F.col("asked")))
    first = inside.select("asked", "area", F.lit(1).alias("tier"), F.struct((~starts).cast("double").alias("a"), (~by_word).cast("double").alias("b"), F.col("area").alias("c")).alias("order"))
    close = close_texts(wanted, known).join(known, "known").select("asked", "area", F.lit(2).alias("tier"), F.struct((-F.col("ratio")).alias("a"), F.lit(0.0).alias("b"), F.col("known").alias("c")).alias("order"))
    alike = close_texts(wanted, words.select(F.col("word").alias("known"))).join(words, F.col("known") == F.col("word")).select("asked", "area", F.lit(3).alias("tier"), F.struct((-F.col("ratio")).alias("a"), F.lit(0.0).alias("b"), F.col("known").alias("c")).alias("order"))
    every = first.unionByName(close).unionByName(alike)
    best = every.groupBy("asked").agg(F.min("tier").alias("tier"))
    one = every.join(best, ["asked", "tier"]).groupBy("asked", "area").agg(F.min("order").alias("order"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy("order"))).filter(F.col("rank") <= top)
    return names.join(ranked.withColumnRenamed("asked", "name"), "name").select("asked", "rank", "area")
