"""Files of the register and of evaluation questions, with strict schemas."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.operators.register import RAW

# The header of the register file.
HEADER = ("Avtalsnummer", "Leverantör", "Organisationsnummer", "Ramavtalsområde", "Delområde", "Giltig från", "Giltig till", "Max förl. till")
GOLD = "id string, category string, area string, question string, answer string, answerable boolean, sources array<struct<source_id:string,keys:array<string>>>"


def register_rows(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(title, raw rows) of a tab-separated register: a title line, the header, and rows numbered as in the file.

    A line of the file is one row; wrong headers raise ValueError.
    """
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).alias("split")
    lines = spark.read.text(path).select("value", split, F.monotonically_increasing_id().alias("at"))
    # Ids are consecutive within a split; a split's lines come after those of the splits before it.
    splits = lines.groupBy("split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(splits.withColumn("before", before), "split").select("value", (F.col("at") - F.col("first") + F.col("before") + 1).alias("source_row"))
    head = [r["value"].split("\t") for r in numbered.filter("source_row <= 2").orderBy("source_row").collect()]
    if len(head) < 2 or tuple(c.strip() for c in head[1]) != HEADER:
        raise ValueError("the second line isn't the register's header")
    cells = F.split("value", "\t", -1)
    rows = numbered.filter((F.col("source_row") > 2) & (F.trim("value") != ""))
    return head[0][0].strip(), rows.select("source_row", *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(RAW)])


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions of a JSON-lines file; a malformed line or a repeated id raises an error."""
    questions = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)
    if not questions.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("two questions have one id")
    return questions


def accepted_findings(spark: SparkSession, path: str) -> DataFrame:
    """(key, reason, reviewer) of a TOML file of [[accepted]] entries; other fields, blank values and repeated keys raise ValueError.

    The list is kept by hand, so it is read whole.
    """
    source = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    entries = tomllib.loads(source)
    if set(entries) - {"accepted"}:
        raise ValueError(f"unknown tables: {sorted(set(entries) - {'accepted'})}")
    fields, rows = ("key", "reason", "reviewer"), []
    for entry in entries.get("accepted", []):
        if set(entry) != set(fields) or not all(isinstance(v, str) and v.strip() for v in entry.values()):
            raise ValueError(f"an entry needs {', '.join(fields)}: {entry}")
        rows.append(tuple(entry[f].strip() for f in fields))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("two entries have one key")
    return spark.createDataFrame(rows, "key string, reason string, reviewer string")


def save(df: DataFrame, path: str) -> None:
    """Replaces a stored table."""
    df.write.mode("overwrite").parquet(path)


def reports(findings: DataFrame) -> DataFrame:
    """One JSON object per check and severity: how many findings, and their subjects."""
    summed = findings.groupBy("check", "severity").agg(F.count("*").alias("findings"), F.array_sort(F.collect_set("subject")).alias("subjects"))
    return summed.select("check", "severity", F.to_json(F.struct("check", "severity", "findings", "subjects")).alias("report"))
