"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Most partitions that a table of few splits is spread over.
SPREAD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; over as many partitions as there are cores, up to SPREAD, where its files have fewer splits, as reading costs little beside what is done with texts."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = min(spark.sparkContext.defaultParallelism, SPREAD)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def ascii_lower(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the quicker function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df; its session passes at most so many rows at a time to Python from now on, as texts may be long. Spark bounds the bytes of a batch itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name, "0")) <= rows:
        conf.set(name, str(rows))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A local session may do without; on a cluster a folder of the driver's own would be lost to the others."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spandrel-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows
