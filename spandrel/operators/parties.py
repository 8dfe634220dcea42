"""The parties that an agreement's party clause names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import identifiers
from spandrel.functions.spans import spans

PARTY, PLACEHOLDER = "party", "placeholder"
SUPPLIER, CUSTOMER = "E1", "E1-customer"
# The clause "mellan <customer>, organisationsnummer <number>, nedan <term>, och <supplier>,
# organisationsnummer <number>, nedan <term>", the number in a slot, and the authority that every agreement has.
_LABEL = r"org(?:anisations)?\.?\s*(?:nummer|nr)\.?:?"
_TERM = r"\(?nedan\s+(?:kallad\s+)?[\"”]?\w+"
CLAUSE = rf"(?isU)(mellan\s+([^,]+?),?\s+{_LABEL}\s*)([^,]+?)(,?\s+{_TERM}[\"”]?\)?,?\s+och\s+(.+?),?\s+{_LABEL}\s*)(.+?),?\s+{_TERM}"
SLOT_NUMBER = r"(?U)(?:[A-Z]{2,3}:?)?\d[\d\s–-]{3,}\d"
AUTHORITY = "202100-0829"
_HEADERS = ("page_header", "page_footer")
_GAP = "\n\n"


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _number(slot: Column) -> Column:
    """The number that a slot is filled with: in its usual form, or as written if it has none; null for a slot without a number."""
    raw = F.nullif(F.regexp_extract(slot, SLOT_NUMBER, 0), F.lit(""))
    return F.coalesce(identifiers.normalize_org_number(F.replace(raw, F.lit("–"), F.lit("-"))), _line(raw))


def find_parties(blocks: DataFrame, authority: str = AUTHORITY) -> DataFrame:
    """(doc, position, kind, rule, value, name, raw) of every party clause in blocks (doc, position, kind, text).

    A clause may run over into the next block that is no page header or footer,
    not further. Its supplier is a party, or a placeholder if the slot holds no
    number; its customer is a party if it is another than the authority. position
    is the block in which the slot's number starts; raw is the clause. Null texts
    count as empty; repeated blocks give repeated rows; no blocks give no rows.
    """
    order = Window.partitionBy("doc").orderBy("position")
    body = blocks.filter(~F.coalesce("kind", F.lit("")).isin(*_HEADERS)).select("doc", "position", F.coalesce("text", F.lit("")).alias("text"))
    body = body.select("doc", "position", "text", F.lead("position").over(order).alias("next_"), F.lead("text").over(order).alias("rest_"))
    window = F.concat_ws(_GAP, "text", "rest_")
    # One that starts in the next block is found from there.
    clauses = F.filter(spans(window, CLAUSE), lambda x: x["start"] < F.length("text"))
    found = body.filter(window.rlike(CLAUSE)).select("doc", "position", "next_", (F.length("text") + len(_GAP)).alias("edge_"), F.explode(clauses).alias("c"))

    part = lambda group: F.regexp_extract("c.raw", CLAUSE, group)
    to_customer = F.length(part(1))
    slot = lambda rule, name, number, at: F.struct(F.lit(rule).alias("rule"), _line(part(name)).alias("name"), _number(part(number)).alias("value"), at.alias("at"))
    slots = F.array(slot(CUSTOMER, 2, 3, to_customer), slot(SUPPLIER, 5, 6, to_customer + F.length(part(3)) + F.length(part(4))))
    each = found.select("doc", "position", "next_", "edge_", "c", F.explode(slots).alias("s"))
    each = each.filter((F.col("s.rule") == SUPPLIER) | (F.col("s.value") != authority))
    return each.select(
        "doc",
        F.when(F.col("c.start") + F.col("s.at") < F.col("edge_"), F.col("position")).otherwise(F.coalesce("next_", "position")).alias("position"),
        F.when(F.col("s.value").isNull(), PLACEHOLDER).otherwise(PARTY).alias("kind"),
        "s.rule",
        F.coalesce("s.value", F.lit("party")).alias("value"),
        "s.name",
        _line(F.col("c.raw")).alias("raw"),
    )
