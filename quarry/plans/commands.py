"""Two more command lines: a search for all three prompts without the ablation, and the sweep over chunk sizes.

    python -m quarry.plans.commands optimize --data_path data/train --budget 100
    python -m quarry.plans.commands chunk_sizes --data_path data/train --chunk_sizes 300 500

Both read documents.json, queries.json and, if there, relevance_labels.json below data_path.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import storage
from quarry.operators import evaluation as E
from quarry.operators import sampling
from quarry.operators import search as S
from quarry.plans import experiment as X
from quarry.plans import indexing, models, rag, reports
from quarry.sources import tables

Encode = Callable[[list[str]], list[list[float]]]


def optimize_options(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="optimize", description="Search for the prompts of all three modules, one after the other")
    for name, default in (("data_path", "data/train"), ("output_dir", "prompt_runs"), ("model", X.MODELS[0])):
        p.add_argument(f"--{name}", default=default)
    for name, default in (("chunk_size", 600), ("chunk_overlap", 50), ("retrieval_k", 20), ("final_k", 10), ("budget", 100)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--use_context", action="store_true")
    return p.parse_args(args)


def labels(spark: SparkSession, data_path: str, raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, doc_id (a chunk's): from relevance_labels.json, whose ids are documents', if it is there, else from the queries' own references."""
    path = f"{data_path}/relevance_labels.json"
    if tables.exists(spark, path):
        told = tables.read_labels(spark, path).withColumnRenamed("doc_id", "of")
        return told.join(chunks.select("chunk_id", "doc_id"), F.col("of") == F.col("doc_id")).select("query_id", F.col("chunk_id").alias("doc_id"))
    return tables.resolve_labels(raw, chunks).withColumnRenamed("chunk_id", "doc_id")


def dense_search(version: indexing.Version, path: str, settings: indexing.Settings, encode: Encode) -> Callable[[DataFrame, int], DataFrame]:
    """The dense half of a hybrid search over a version's vectors; equal query texts are embedded once, and kept."""

    def search(queries: DataFrame, k: int) -> DataFrame:
        asked = indexing.embed_queries(queries, path, settings, encode).where("status = 'success'")
        return S.dense(version.vectors(), asked, k)

    return search


def optimize(args: list[str], client=None, propose: Callable[[str, DataFrame], str] | None = None, encode: Encode | None = None, dimension: int = 0) -> dict:
    """Planner, reranker and generator searched in turn, each with the best prompts before it; their records and the best prompts are written.

    With --use_context the client says of each chunk where it stands; with encode lists are hybrid.
    """
    a, spark = optimize_options(args), SparkSession.builder.getOrCreate()
    client, propose = client or models.RuleClient(), propose or (lambda prompt, records: prompt)
    config = X.Config("optimize", a.output_dir, budget=a.budget, model=a.model, chunk_size=a.chunk_size, chunk_overlap=a.chunk_overlap, retrieval_k=a.retrieval_k, rerank_k=a.final_k)
    raw = tables.read_queries(spark, f"{a.data_path}/queries.json")
    docs = tables.read_documents(spark, f"{a.data_path}/documents.json").select("doc_id", "text")
    settings = indexing.Settings(a.chunk_size, a.chunk_overlap, dimension=dimension or X.dimension(""))
    version = indexing.build(docs, f"{a.output_dir}/index", settings, client if a.use_context else None, encode)
    told = storage.write(labels(spark, a.data_path, raw, version.chunks), "labels")
    texts = version.chunks.select(F.col("chunk_id").alias("doc_id"), F.col("contextualized").alias("text"))
    dense = dense_search(version, f"{a.output_dir}/index", settings, encode) if encode else None
    corpus = X.Corpus(texts, version.index(), told, raw.select("query_id", "ground_truth"), dense)
    asked = storage.write(E.split(raw.select("query_id", F.col("query").alias("text")), config.seed, (config.train_ratio, config.val_ratio)), "asked")
    of = {s: asked.where(F.col("split") == s).drop("split") for s in ("train", "validation")}
    prompts, records = X.default_prompts(), []
    for module in X.MODULES:
        record = X.optimise_module(X.adapter(module, corpus, client, config, prompts), of["train"], of["validation"], propose, config.budget, config.search, config.minibatch, config.seed)
        prompts = X.with_prompt(prompts, module, record["best_prompt"])
        records.append(record)
        reports.write_json(spark, record, f"{a.output_dir}/{module}_results.json")
    X.save_prompts(spark, f"{a.output_dir}/prompts", prompts, "final_optimized")
    return {"prompts": prompts, "modules": records, "chunks": version.n}


def chunk_size_options(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="chunk_sizes", description="Find the chunk size that retrieves best")
    for name, default in (("data_path", "data/train"), ("output_dir", "data/chunk_optimization"), ("embedding_model", "text-embedding-3-small")):
        p.add_argument(f"--{name}", default=default)
    p.add_argument("--chunk_sizes", type=int, nargs="+", default=[256, 512, 1024, 2048])
    p.add_argument("--overlap_ratio", type=float, default=0.1)
    p.add_argument("--retrieval_k", type=int, default=20)
    p.add_argument("--rrf_k", type=int, default=S.RRF_K)
    p.add_argument("--rrf_weight", type=float, default=0.5)
    p.add_argument("--no-cache", dest="cache", action="store_false")
    return p.parse_args(args)


def chunk_sizes(args: list[str], encode: Encode | None = None, dimension: int = 0) -> dict:
    """The sweep's report, which is written too: over representative queries where there are vectors to choose by, with both lists fused.

    Vectors of chunks and queries are kept by content in output_dir; --no-cache forgets them first.
    """
    a, spark = chunk_size_options(args), SparkSession.builder.getOrCreate()
    docs = tables.read_documents(spark, f"{a.data_path}/documents.json").select("doc_id", "text")
    asked = tables.read_queries(spark, f"{a.data_path}/queries.json").select("query_id", F.col("query").alias("text"))
    told = tables.read_labels(spark, f"{a.data_path}/relevance_labels.json")
    settings = indexing.Settings(model=a.embedding_model, dimension=dimension or X.dimension(a.embedding_model))
    if not a.cache:
        indexing.clear_cache(spark, a.output_dir)
    dense = None
    if encode is not None:
        vectors = storage.write(indexing.embed_queries(asked, a.output_dir, settings, encode), "query-vectors").where("status = 'success'")
        chosen = storage.write(sampling.representatives(vectors, closed=True, small=10), "representatives")
        asked = asked.join(chosen.select("query_id"), "query_id", "left_semi")

        def dense(chunks: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
            keyed = chunks.withColumn("key", indexing.content_key(settings, False, F.col("text"), F.lit("")))
            rows = storage.write(keyed.select("chunk_size", F.col("doc_id").alias("chunk_id"), F.col("of").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"), "key"), "keyed")
            indexing.fill_cache(rows, docs, a.output_dir, settings, None, encode)
            known = indexing.read_cache(spark, a.output_dir).where("embedding is not null").select(F.col("key").alias("k"), "embedding")
            found = rows.join(known, F.col("key") == F.col("k")).select("chunk_size", F.col("chunk_id").alias("doc_id"), "embedding")
            return S.dense(found, vectors.join(queries.select("query_id"), "query_id", "left_semi").select("query_id", "embedding"), depth, by="chunk_size")

    found = storage.write(rag.sweep(docs, asked, told, tuple(a.chunk_sizes), a.overlap_ratio, a.retrieval_k, a.rrf_weight, dense, a.rrf_k), "sweep")
    report = reports.sweep_report(found, rag.best_size(found))
    reports.write_json(spark, report, f"{a.output_dir}/chunk_size_results.json")
    return report


COMMANDS = {"optimize": optimize, "chunk_sizes": chunk_sizes}

if __name__ == "__main__":
    print(COMMANDS[sys.argv[1]](sys.argv[2:]))
