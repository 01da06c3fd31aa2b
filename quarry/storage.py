"""Tables written once and read again: an index, or a run that several queries share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MADE: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where it is unset, a new one if all runs in one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = "file://" + tempfile.mkdtemp(prefix="quarry-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/quarry/{spark.sparkContext.applicationId}"


def write(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> str:
    """What tells one state of a folder from another: bytes, files, and when it and its entries changed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    content = system.getContentSummary(hadoop)
    changed = [x.getModificationTime() for x in system.listStatus(hadoop)]
    return f"{content.getLength()}-{content.getFileCount()}-{max(changed, default=0)}"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def alive(df: DataFrame) -> bool:
    """Whether the files of a written table are still there."""
    files = df.inputFiles()
    return bool(files) and exists(df.sparkSession, files[0])


def once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make gives, written at its first use in the application for this state of the folder source."""
    key = (spark.sparkContext.applicationId, source, stamp(spark, source), name)
    if key not in _MADE or not exists(spark, f"{_MADE[key]}/_SUCCESS"):  # the shared folder may have been cleared
        df = make()
        path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        _MADE[key] = path
    return spark.read.parquet(_MADE[key])


#: Bytes a core up to which a table is dealt anew.
LIGHT = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of few files dealt over all cores: a file may be a single row group, which one task would read; others as they are."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= LIGHT * cores and len(df.inputFiles()) < cores else df


def place(df: DataFrame, *order: str, by: str | None = None, name: str = "place") -> DataFrame:
    """df with its place (from 0) in the order of the columns, in each group of ``by``: a range sort, counted a part at a time."""
    keys = [*([by] if by else []), *order]
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    parts = write(parts, "ordered").withColumn("__part", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND((1 << 33) - 1))
    w = Window.partitionBy(F.lit(0)).orderBy("__part")  # one row a part
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(w) - F.col("__n")).drop("__n")
    placed = parts.join(F.broadcast(counts), "__part").withColumn(name, F.col("__before") + F.col("__in"))
    if by:
        first = placed.groupBy(by).agg(F.min(name).alias("__first"))  # one row a group
        placed = placed.join(F.broadcast(first), by).withColumn(name, F.col(name) - F.col("__first")).drop("__first")
    return write(placed.drop("__at", "__part", "__in", "__before"), "placed")
