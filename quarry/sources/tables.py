"""JSON sources, the stored index, the embedding cache and checkpoints; all paths are Spark's, local or not."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import chunking
from quarry.functions import text as T
from quarry.storage import exists

DOCUMENTS = "id string, doc_id string, text string, content string, chunk_id string, chunk_index int, parent_doc_id string"
QUERIES = "query_id string, query string, ground_truth string, reference_doc_ids array<string>, reference_chunk_ids array<string>, reference_evidence_texts array<string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """An array of documents: doc_id (else id), text (else content), and the columns of chunks made before."""
    raw = spark.read.schema(DOCUMENTS).option("multiLine", True).json(path)
    return raw.select(F.coalesce("doc_id", "id").alias("doc_id"), F.coalesce("text", "content").alias("text"), "chunk_id", "chunk_index", "parent_doc_id")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERIES).option("multiLine", True).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id from one object of id lists; queries without ids have no row."""
    whole = spark.read.text(path, wholetext=True)
    lists = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query_id", "ids"))
    return lists.select("query_id", F.explode("ids").alias("doc_id")).distinct()


def read_text(spark: SparkSession, path: str) -> str:
    """A prompt, or any other small text file."""
    return spark.read.text(path, wholetext=True).first().value


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A folder with one part, which read_text reads again; a text is one line after another."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\x00").text(path)


def _unmarked(text: str) -> str:
    return text.rstrip("\x00")


def read_chunk_size(spark: SparkSession, path: str, size: int, overlap: int) -> tuple[int, int]:
    """Size and overlap of the best result of a sweep; the given ones where it can't be read."""
    try:
        best = json.loads(_unmarked(read_text(spark, path)))["best"]
        return int(best["chunk_size"]), int(best["chunk_overlap"])
    except Exception as problem:  # a missing or broken file means the caller's choice
        warnings.warn(f"no chunk size in {path}: {problem}", stacklevel=2)
        return size, overlap


def chunk_documents(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """chunk_id, doc_id, chunk_index, chunk: documents that have a chunk_id pass as they are."""
    ready = docs.where("chunk_id is not null and text is not null").select("chunk_id", F.coalesce("parent_doc_id", "doc_id").alias("doc_id"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.col("text").alias("chunk"))
    return chunking.chunk_table(docs.where("chunk_id is null"), size, overlap).unionByName(ready)


def resolve_labels(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id: known reference chunks; for queries without any, reference documents by chunk or parent id."""
    ids = chunks.select("chunk_id", "doc_id")
    direct = queries.select("query_id", F.explode("reference_chunk_ids").alias("chunk_id")).join(ids, "chunk_id", "left_semi").select("query_id", "chunk_id")
    rest = queries.join(direct, "query_id", "left_anti").select("query_id", F.explode("reference_doc_ids").alias("ref"))
    as_chunk = rest.join(ids, rest["ref"] == ids["chunk_id"]).select("query_id", "ref", "chunk_id")
    other = rest.join(as_chunk.select("query_id", "ref"), ["query_id", "ref"], "left_anti")
    by_doc = other.join(ids, other["ref"] == ids["doc_id"]).select("query_id", "chunk_id")
    return direct.unionByName(as_chunk.select("query_id", "chunk_id")).unionByName(by_doc).distinct()


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    hadoop, system = _file_system(spark, path)
    system.delete(hadoop, True)


def save_index(path: str, **tables: DataFrame) -> None:
    """chunks, postings, lengths, embeddings: each a Parquet table below path, and their manifest, written last."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        write_manifest(spark, path, {name: spark.read.parquet(f"{path}/{name}") for name in tables}, {})


def load_index(spark: SparkSession, path: str, *names: str, make: dict[str, Callable[[], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """The tables of an index. With ``make`` they are verified: one that is missing or altered is made anew, or is an error if it can't be."""
    if make is not None:
        manifest = read_manifest(spark, path)
        bad = [n for n in broken_parts(spark, path, manifest) if n in names]
        for name in bad:
            if name not in make:
                raise ValueError(f"{name} of {path} is missing or altered")
            make[name]().write.mode("overwrite").parquet(f"{path}/{name}")
        if bad:
            write_manifest(spark, path, {n: spark.read.parquet(f"{path}/{n}") for n in manifest["parts"]}, manifest["state"])
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def digest(table: DataFrame) -> dict:
    """rows, and a sum of hashes over all columns that no order of rows changes."""
    row = table.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": row.rows, "sum": str(row["sum"]), "schema": table.schema.simpleString()}


def write_manifest(spark: SparkSession, path: str, parts: dict[str, DataFrame], state: dict) -> None:
    """What each part of an index holds, and the state of the whole; a part that a manifest doesn't tell of isn't there yet."""
    write_text(spark, json.dumps({"parts": {name: digest(table) for name, table in parts.items()}, "state": state}), f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"{path} has no manifest: its build didn't end")
    return json.loads(_unmarked(read_text(spark, f"{path}/manifest")))


def broken_parts(spark: SparkSession, path: str, manifest: dict) -> list[str]:
    """The parts that are missing, can't be read, or hold other rows than the manifest tells."""
    bad = []
    for name, told in manifest["parts"].items():  # a handful
        try:
            fine = digest(spark.read.parquet(f"{path}/{name}")) == told
        except (AnalysisException, Py4JError, PySparkException):
            fine = False
        if not fine:
            bad.append(name)
    return bad


def fingerprint(config: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def cached_embeddings(spark: SparkSession, path: str, chunk_size: int, chunks: DataFrame, model: str, overlap: int, make) -> DataFrame:
    """chunk_id, embedding from the cache where model, overlap and the chunks' content are those that it was made of; else made and written.

    One folder for each chunk size and manifest: an outdated one is never read.
    """
    content = chunks.agg(F.count("*").alias("n"), F.sum(F.xxhash64("chunk_id", "chunk").cast("decimal(38,0)")).alias("h")).first()
    key = fingerprint({"model": model, "overlap": overlap, "n": content.n, "hash": str(content.h)})[:16]
    folder = f"{path}/chunk_size={chunk_size}/{key}"
    if not exists(spark, folder + "/_SUCCESS"):
        make(chunks).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def save_checkpoint(spark: SparkSession, folder: str, phase: int, state: dict, config: dict) -> None:
    write_text(spark, json.dumps({**state, "phase": phase, "completed": True, "config_hash": fingerprint(config)}, default=str), f"{folder}/checkpoint_phase_{phase}.json")


def load_checkpoint(spark: SparkSession, folder: str, phase: int, config: dict) -> dict | None:
    """The state of a phase, None without one; another configuration's gives a warning."""
    path = f"{folder}/checkpoint_phase_{phase}.json"
    if not exists(spark, path):
        return None
    state = json.loads(_unmarked(read_text(spark, path)))
    if state["config_hash"] != fingerprint(config):
        warnings.warn("the checkpoint is of another configuration", stacklevel=2)
    return state


def restore_queries(queries: DataFrame, ids: list[str]) -> DataFrame:
    """The queries of a list of ids with their place; unknown ids have none."""
    spark = queries.sparkSession
    listed = spark.createDataFrame([(str(q), i) for i, q in enumerate(ids)], "query_id string, place int")
    return queries.join(F.broadcast(listed), queries["query_id"].cast("string") == listed["query_id"]).drop(listed["query_id"]).orderBy("place")


def labels_by_hash(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """hash, doc_id: labels of queries (query_id, text) registered under their hash, so that a query finds them by its text. Labels of equal queries are joined."""
    hashed = queries.select("query_id", T.query_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    return qrels.join(hashed, "query_id").select("hash", "doc_id").distinct()


def registered(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, doc_id of queries (query_id, text) whose text has registered labels, whatever their ids were then."""
    hashed = asked.select("query_id", T.query_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    return hashed.join(labels, "hash").select("query_id", "doc_id")


def missing_from_cache(queries: DataFrame, cache: DataFrame, key: str = "hash") -> DataFrame:
    return queries.join(cache.select(key), key, "left_anti")


def first_of_key(table: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return table.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, order: str, default=-1) -> DataFrame:
    """left with the value of the first right row of its key; the default where there is none, or the key is empty."""
    first = first_of_key(right.where(F.col(key) != ""), key, order).select(key, value)
    return left.join(first, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
