"""An index that is kept up: chunked, contextualised, embedded and inverted; a later build does only what changed.

What a model makes of a chunk is kept by content, in a cache that outlives versions: a chunk's key is a
digest of the chunk, of its document where that is part of the prompt, and of the settings. A build
chunks all documents, finds by an anti join the keys that the cache has not, and asks and embeds for those alone. A
version's postings, document counts and lengths are those of the version before, without the chunks that went and
with those that came. A manifest, written last, tells each part's rows and digest: a load verifies them and
makes anew only a part that is missing or altered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import storage
from quarry.functions import chunking
from quarry.functions import text as T
from quarry.operators import search as S
from quarry.plans import models
from quarry.sources import tables

PARTS = ("chunks", "terms", "stats")


@dataclass(frozen=True)
class Settings:
    """What an index depends on besides its documents. Without a client chunks stand alone; without encode there are no vectors."""

    size: int = 600
    overlap: int = 50
    model: str = "text-embedding-3-small"
    dimension: int = 1536
    prompt: str = models.PROMPTS["context"]
    context_model: str = ""

    def key(self, contextual: bool) -> str:
        return tables.fingerprint({"model": self.model, "dimension": self.dimension, **({"prompt": self.prompt, "by": self.context_model} if contextual else {})})


@dataclass(frozen=True)
class Version:
    """A built index: chunks (chunk_id, doc_id, chunk_index, chunk, key, contextualized, has_context, embedding), terms, stats, and what was made for it."""

    path: str
    chunks: DataFrame
    terms: DataFrame  # chunk_id as doc_id, dl, terms
    stats: DataFrame  # term, df
    n: int
    tokens: int  # of all chunks
    made: int = 0  # keys that a model was asked for

    def index(self) -> S.Index:
        """As the sparse search takes it: idf follows from the counts, no posting is read for it."""
        weighed = S.weigh(self.stats, self.n)
        mean = weighed.agg(F.avg("raw").alias("m")).first().m
        postings, lengths = S.of_terms(self.terms)
        return S.Index(postings, weighed.drop("raw"), lengths.select("doc_id"), self.tokens / self.n if self.n else 0.0, mean or 0.0)

    def vectors(self) -> DataFrame:
        """doc_id (the chunk's), embedding, for the dense search; chunks whose call failed have none."""
        return self.chunks.where("embedding is not null").select(F.col("chunk_id").alias("doc_id"), "embedding")


def content_key(settings: Settings, contextual: bool, chunk: Column, document: Column) -> Column:
    """A digest of all that a chunk's context and vector follow from."""
    parts = [F.lit(settings.key(contextual)), F.sha2(chunk.cast("binary"), 256), *([F.sha2(document.cast("binary"), 256)] if contextual else [])]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


CACHE = "key string, context string, embedding array<double>, asked boolean"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, context, embedding, asked of all that was ever made; empty where there is none."""
    folder = f"{path}/cache"
    if not tables.exists(spark, folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder).dropDuplicates(["key"])


def clear_cache(spark: SparkSession, path: str) -> None:
    """Forget what models made: the next build asks for everything again; built versions stay."""
    tables.remove(spark, f"{path}/cache")


def fill_cache(chunks: DataFrame, docs: DataFrame, path: str, settings: Settings, client: models.Client | None, encode: Callable[[list[str]], list[list[float]]] | None, **retry) -> int:
    """Ask and embed for the keys of chunks (key, doc_id, chunk) that the cache has not, and append them; how many there were.

    Equal chunks are asked for once. What failed is not kept, so that the next build tries it again.
    """
    spark = chunks.sparkSession
    missing = chunks.dropDuplicates(["key"]).join(read_cache(spark, path).select("key"), "key", "left_anti")
    missing = storage.write(missing.select("key", "doc_id", "chunk_id", "chunk_index", "chunk"), "missing")
    n = missing.count()
    if not n or (client is None and encode is None):
        return 0
    if client is None:
        told = missing.select("key", "chunk", F.lit("").alias("context"), F.col("chunk").alias("full"), F.lit("success").alias("status"))
    else:
        asked = models.contextualize(missing.withColumnsRenamed({"chunk_id": "was", "key": "chunk_id"}), docs, client, settings.prompt, **retry)
        told = asked.select(F.col("chunk_id").alias("key"), "chunk", "context", F.col("contextualized").alias("full"), "status")
    told = storage.write(told, "told")
    if encode is None:
        vectors = told.select(F.col("key").alias("k"), F.lit(None).cast("array<double>").alias("embedding"), F.lit("success").alias("embedded"))
    else:
        vectors = models.embed(told, encode, settings.dimension, "key", "full").withColumnsRenamed({"key": "k", "status": "embedded"})
    made = told.join(vectors, F.col("key") == F.col("k")).where("status = 'success' and embedded <> 'error'")
    made.select("key", "context", "embedding", F.lit(client is not None).alias("asked")).write.mode("append").parquet(f"{path}/cache")
    return n


def _merged_stats(old: DataFrame, gone: DataFrame, came: DataFrame) -> DataFrame:
    """term, df: the counts of before, less those of the chunks that went, and those of the ones that came; unused terms are dropped."""
    count = lambda rows, sign: rows.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg((F.count("*") * sign).alias("df"))
    return old.unionByName(count(gone, -1)).unionByName(count(came, 1)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def build(docs: DataFrame, path: str, settings: Settings = Settings(), client: models.Client | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None, before: Version | None = None, name: str = "v1", tokenize=T.tokens, **retry) -> Version:
    """The index of docs (doc_id, text) as version ``name`` below path; with ``before`` only what differs is inverted.

    A chunk whose call failed is indexed by its own text, without a vector.
    """
    spark, contextual = docs.sparkSession, client is not None
    at = f"{path}/{name}"
    cut = chunking.chunk_table(docs, settings.size, settings.overlap)
    keyed = cut.join(docs.select("doc_id", F.col("text").alias("document")), "doc_id") if contextual else cut.withColumn("document", F.lit(""))
    keyed = keyed.withColumn("key", content_key(settings, contextual, F.col("chunk"), F.col("document"))).drop("document")
    keyed = storage.write(keyed, "keyed")
    made = fill_cache(keyed, docs, path, settings, client, encode, **retry)
    cache = read_cache(spark, path).select(F.col("key").alias("k"), "context", "embedding")
    whole = keyed.join(cache, F.col("key") == F.col("k"), "left")
    chunks = whole.select("chunk_id", "doc_id", "chunk_index", "chunk", "key", T.with_context(F.col("context"), F.col("chunk")).alias("contextualized"), (F.coalesce("context", F.lit("")) != "").alias("has_context"), "embedding")
    chunks.write.mode("overwrite").parquet(f"{at}/chunks")
    chunks = spark.read.parquet(f"{at}/chunks")
    now = chunks.select(F.col("chunk_id").alias("c"), F.sha2(F.col("contextualized").cast("binary"), 256).alias("h"))
    if before is None:
        terms = S.terms(storage.spread(chunks), tokenize, "chunk_id", "contextualized")
        _write(terms, f"{at}/terms")
        terms = spark.read.parquet(f"{at}/terms")
        _write(_merged_stats(spark.createDataFrame([], "term string, df long"), terms.limit(0), terms), f"{at}/stats")
    else:
        was = before.chunks.select(F.col("chunk_id").alias("c"), F.sha2(F.col("contextualized").cast("binary"), 256).alias("h"))
        gone = storage.write(was.join(now, ["c", "h"], "left_anti").select("c"), "gone")
        came = storage.write(now.join(was, ["c", "h"], "left_anti").select("c"), "came")
        left = before.terms.join(gone, F.col("doc_id") == F.col("c"), "left_semi")
        new = storage.write(S.terms(chunks.join(came, F.col("chunk_id") == F.col("c"), "left_semi"), tokenize, "chunk_id", "contextualized"), "new-terms")
        _write(before.terms.join(gone, F.col("doc_id") == F.col("c"), "left_anti").unionByName(new), f"{at}/terms")
        _write(_merged_stats(before.stats, left, new), f"{at}/stats")
    parts = {p: spark.read.parquet(f"{at}/{p}") for p in PARTS}
    total = parts["terms"].agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).first()
    state = {"settings": settings.key(contextual), "size": settings.size, "overlap": settings.overlap, "n": total.n, "tokens": total.tokens or 0}
    tables.write_manifest(spark, at, parts, state)
    return Version(at, **parts, n=total.n, tokens=total.tokens or 0, made=made)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, name: str = "v1", tokenize=T.tokens) -> tuple[Version, list[str]]:
    """The version as its manifest has it, and the parts that had to be made anew: terms from the chunks, stats from the terms.

    A version without a manifest, or whose chunks are missing or altered, is an error: they need documents and a build.
    """
    at = f"{path}/{name}"
    manifest = tables.read_manifest(spark, at)
    bad = tables.broken_parts(spark, at, manifest)
    if "chunks" in bad:
        raise ValueError(f"the chunks of {at} are missing or altered: build the index again")
    chunks = spark.read.parquet(f"{at}/chunks")
    if "terms" in bad:
        _write(S.terms(storage.spread(chunks), tokenize, "chunk_id", "contextualized"), f"{at}/terms")
    terms = spark.read.parquet(f"{at}/terms")
    if "stats" in bad:
        _write(_merged_stats(spark.createDataFrame([], "term string, df long"), terms.limit(0), terms), f"{at}/stats")
    parts = {p: spark.read.parquet(f"{at}/{p}") for p in PARTS}
    if bad:
        tables.write_manifest(spark, at, parts, manifest["state"])
    return Version(at, **parts, n=manifest["state"]["n"], tokens=manifest["state"]["tokens"]), sorted(bad)


def embed_queries(queries: DataFrame, path: str, settings: Settings, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """query_id, embedding, status of queries (query_id, text) by their hash: equal queries, and those that were embedded before, are not embedded again.

    status is success, blank (no text: no vector) or error (the call failed; the next call tries it again).
    """
    spark, folder = queries.sparkSession, f"{path}/queries-{tables.fingerprint({'model': settings.model, 'dimension': settings.dimension})[:16]}"
    schema = "hash string, embedding array<double>"
    known = lambda: spark.read.schema(schema).parquet(folder) if tables.exists(spark, folder) else spark.createDataFrame([], schema)
    hashed = storage.write(queries.select("query_id", "text", T.query_hash(F.coalesce("text", F.lit(""))).alias("hash"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank")), "hashed")
    missing = tables.missing_from_cache(hashed.where("not blank").groupBy("hash").agg(F.min("text").alias("text")), known())
    missing = storage.write(missing, "missing-queries")
    if not missing.isEmpty():
        models.embed(missing, encode, settings.dimension, "hash", "text").where("status = 'success'").select("hash", "embedding").write.mode("append").parquet(folder)
    found = hashed.join(known().dropDuplicates(["hash"]).withColumnRenamed("hash", "h"), F.col("hash") == F.col("h"), "left")
    return found.select("query_id", "embedding", F.when(F.col("blank"), "blank").when(F.col("embedding").isNull(), "error").otherwise("success").alias("status"))
