"""What the operators of this subpackage share: shared storage, Arrow helpers, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcasts stay under this many bytes; beyond it, operators work in blocks or joins.
BROADCAST_BYTES = 32 << 20


#: Rows (two longs each) that are broadcast at most.
BROADCAST_ROWS = 500_000
#: A key with more than this share's inverse of all rows is hot; there are at most so many.
HOT_KEYS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where it is unset, a new one if all runs in one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = "file://" + tempfile.mkdtemp(prefix="quarry-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts the lineage.

    Tables live under ``quarry/<application id>/`` and may go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Caches that a worker process keeps between tasks, by the operator that fills them.
CACHES: dict[str, dict] = {}


def only_cache(of: str) -> None:
    """Empty the caches of all other operators: a worker process serves many stages, and its memory is one."""
    for name, cache in CACHES.items():
        if name != of:
            cache.clear()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, named in one place."""
    return df.mapInArrow(fn, schema)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores before them until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return tuple(out)


def small(rows: DataFrame) -> DataFrame:
    """A written table of two longs a row, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def join_counted(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], n: str, how: str = "inner", least: int = 1) -> DataFrame:
    """left joined to right (inner or left), a written table with one row a key and n, how many rows of left have the key.

    Keys with over 1 / HOT_KEYS of the rows and more than ``least``, at most HOT_KEYS of them, are broadcast and their rows stay
    where they are; the rest is shuffled by key, where no key is large. left is read twice; it should be
    light and written.
    """
    total, most = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    keys = [F.col(a) == F.col(b) for a, b in on]
    bound = max(least, total / HOT_KEYS)
    if most <= bound:
        return left.join(right, keys, how)
    hot = F.col(n) > bound
    often = F.broadcast(right.where(hot))
    rest = left.join(often, keys, "left_anti").join(right.where(~hot), keys, how)
    return left.join(often, keys).unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts, for what takes each text apart: a batch of texts in pieces is many times as large."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blobs(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def whole(text: str):
    """A text column whose nulls are empty."""
    return F.coalesce(F.col(text), F.lit(""))


#: bytes.translate table: A-Z to lower case, all else as it is.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: As above, and every ASCII byte that is no digit or letter becomes a space.
ALNUM = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))

#: The lower-casing of A-Z alone, for columns.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(column):
    return F.translate(column, UPPER, LOWER)
