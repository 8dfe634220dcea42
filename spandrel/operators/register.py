"""The register: normalised rows, its tables, conflicts, and the search over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import dates, identifiers

SEPARATOR = " / "
#: Columns of a raw row, as text, after source_row.
RAW = ("agreement", "supplier", "org", "area", "sub_area", "valid_from", "valid_to", "max_extension_to")


def normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of raw register rows (source_row and RAW): rejected has (source_row, reason), the first in the order of RAW."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    parts = {
        "number": identifiers.split_agreement_number(F.col("agreement")),
        "name": identifiers.supplier_name(F.col("supplier")),
        "org_number": identifiers.normalize_org_number(F.trim("org")),
        "sub_area_path": identifiers.sub_area_path(F.trim("sub_area")),
        "from": dates.iso_date(F.col("valid_from")),
        "to": dates.iso_date(F.col("valid_to")),
        "extension": dates.iso_date(F.col("max_extension_to")),
    }
    # A filter on what inline() returns can't be pushed below it, where the forms would be evaluated again.
    read = raw.select("*", *[c.alias(f"{n}_") for n, c in parts.items()]).select(*raw.columns, F.inline(F.array(F.struct(*[F.col(f"{n}_").alias(n) for n in parts]))))
    rules = [*[(blank(c), f"{c} is empty") for c in ("agreement", "supplier", "org", "area", "sub_area", "valid_from", "valid_to")]]
    rules += [(F.col(p).isNull(), f"{c} has an unknown format") for p, c in (("number", "agreement"), ("org_number", "org"), ("sub_area_path", "sub_area"), ("from", "valid_from"), ("to", "valid_to"))]
    rules += [(~blank("max_extension_to") & F.col("extension").isNull(), "max_extension_to has an unknown format")]
    judged = read.withColumn("reason", F.coalesce(*[F.when(test, text) for test, text in rules]))
    rows = judged.filter("reason IS NULL").select(
        "source_row",
        F.col("number.full").alias("agreement_number"),
        F.col("number.procurement").alias("procurement_number"),
        F.col("number.sequence").alias("sequence"),
        F.col("name.name").alias("supplier_name"),
        F.col("name.former").alias("former_supplier_name"),
        "org_number",
        F.trim("area").alias("framework_area"),
        "sub_area_path",
        F.col("from").alias("valid_from"),
        F.col("to").alias("valid_to"),
        F.col("extension").alias("max_extension_to"),
    )
    return rows, judged.filter("reason IS NOT NULL").select("source_row", "reason")


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the smallest source_row of each key, aggregated before the shuffle; of rows with equal source_row, the smallest by the other columns."""
    others = ["source_row", *[c for c in rows.columns if c not in (*keys, "source_row")]]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("x_"))
    return best.select(*keys, "x_.*")


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The register's tables; where rows disagree the first one wins. A sub-area's key is (framework_area, path)."""
    levels = F.transform(F.sequence(F.lit(1), F.size("sub_area_path")), lambda n: F.slice("sub_area_path", 1, n))
    prefixes = rows.select("framework_area", F.explode(levels).alias("path")).distinct()
    join = lambda c: F.array_join(c, SEPARATOR)
    path = join(F.col("sub_area_path")).alias("path")
    return {
        "procurement": rows.select("procurement_number").distinct(),
        "supplier": rows.select("org_number").distinct(),
        "supplier_name": _first(rows, ["org_number", "supplier_name"]).select("org_number", F.col("supplier_name").alias("name"), F.col("former_supplier_name").alias("former_name")),
        "agreement": _first(rows, ["agreement_number"]).select("agreement_number", "procurement_number", "sequence", "org_number", "supplier_name"),
        "sub_area": prefixes.select("framework_area", join(F.col("path")).alias("path"), F.element_at("path", -1).alias("name"), F.size("path").alias("level"), F.when(F.size("path") > 1, join(F.expr("slice(path, 1, size(path) - 1)"))).alias("parent_path")),
        "agreement_sub_area": _first(rows.withColumn("path_", F.col("sub_area_path")).select("source_row", "agreement_number", "framework_area", path, "valid_from", "valid_to", "max_extension_to"), ["agreement_number", "framework_area", "path"]).drop("source_row"),
    }


def conflicts(rows: DataFrame) -> DataFrame:
    """(source_row, kind, first_row): rows whose organisation differs from their agreement's first row, and repeated keys."""
    keyed = rows.withColumn("path", F.array_join("sub_area_path", SEPARATOR))
    first = keyed.groupBy("agreement_number").agg(F.min_by(F.struct("source_row", "org_number"), "source_row").alias("f"))
    other = keyed.join(first, "agreement_number").filter(F.col("org_number") != F.col("f.org_number")).select("source_row", F.lit("org_number").alias("kind"), F.col("f.source_row").alias("first_row"))
    key = ["agreement_number", "org_number", "framework_area", "path"]
    once = keyed.groupBy(*key).agg(F.min("source_row").alias("first_row"))
    again = keyed.join(once, key).filter("source_row > first_row").select("source_row", F.lit("repeated").alias("kind"), "first_row")
    return other.unionByName(again)


def foreign_org_numbers(rows: DataFrame) -> DataFrame:
    """(org_number, source_row, supplier_name) of the first row of each organisation that isn't Swedish."""
    foreign = rows.filter(~identifiers.is_swedish_org_number(F.col("org_number")))
    return _first(foreign, ["org_number"]).select("org_number", "source_row", "supplier_name")


def contains(column: str, text: str) -> Column:
    """Whether column contains text, whatever the case; % and _ have no meaning."""
    return F.lower(column).contains(F.lower(F.lit(text)))


def search(register: dict[str, DataFrame], supplier: str | None = None, agreement: str | None = None, area: str | None = None, sub_area: str | None = None, org: str | None = None, valid_on: str | None = None) -> DataFrame:
    """Every agreement in a sub-area that meets all filters; at least one but valid_on has to be given.

    A supplier is found by a part of its own name or of any name of its
    organisation. A number without a sequence gives the whole procurement.
    Every part of sub_area, between slashes, has to be in the path.
    """
    name = " ".join((supplier or "").split())
    parts = [" ".join(p.split()) for p in (sub_area or "").split("/") if p.strip()]
    if not any((name, agreement, area, parts, org)):
        raise ValueError("give one of supplier, agreement, area, sub_area and org at least")
    agreements = register["agreement"]
    if name:
        known = register["supplier_name"].filter(contains("name", name) | contains("former_name", name)).select("org_number").distinct().withColumn("known_", F.lit(True))
        agreements = agreements.join(known, "org_number", "left").filter(contains("supplier_name", name) | F.col("known_")).drop("known_")
    if org:
        agreements = agreements.filter(F.col("org_number") == identifiers.normalize_org_number(F.lit(org)))
    if agreement:
        wanted = F.lit(agreement)
        agreements = agreements.filter((identifiers.agreement_key(F.col("agreement_number")) == identifiers.agreement_key(wanted)) | (identifiers.procurement_key(F.col("procurement_number")) == identifiers.procurement_key(wanted)))
    links = register["agreement_sub_area"]
    if area:
        links = links.filter(F.lower("framework_area") == F.lower(F.trim(F.lit(area))))
    links = reduce(lambda d, p: d.filter(contains("path", p)), parts, links)
    if valid_on:
        links = links.filter(F.lit(valid_on).cast("date").between(F.col("valid_from"), F.col("valid_to")))
    return agreements.join(links, "agreement_number").select("agreement_number", "procurement_number", "supplier_name", "org_number", "framework_area", F.col("path").alias("sub_area"), "valid_from", "valid_to", "max_extension_to")


SEARCH_ORDER = ("framework_area", "agreement_number", "sub_area")


def search_page(found: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of search(), with the total of all pages in every row."""
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(*SEARCH_ORDER).offset(offset).limit(limit).join(F.broadcast(total))


def former_names(register: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """(org_number, former_names) of the organisations found."""
    names = register["supplier_name"].filter("former_name IS NOT NULL").join(found.select("org_number").distinct(), "org_number", "left_semi")
    return names.groupBy("org_number").agg(F.array_sort(F.collect_set("former_name")).alias("former_names"))


def period(links: DataFrame, by: str = "agreement_number") -> DataFrame:
    """First start, last end and last extension of each agreement."""
    return links.groupBy(by).agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), F.max("max_extension_to").alias("max_extension_to"))


def newest_row(rows: DataFrame, by: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("valid_to"), "agreement_number")
    return rows.withColumn("place_", F.row_number().over(w)).filter("place_ = 1").drop("place_")
