"""The whole way from a question to a judged answer, and the searches over its parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import storage
from quarry.functions import chunking
from quarry.functions import text as T
from quarry.operators import evaluation as E
from quarry.operators import scoring as C
from quarry.operators import search as S
from quarry.operators import swept
from quarry.plans import models


def retrieve(planned: DataFrame, docs: DataFrame, k: int = 20, index: S.Index | None = None, dense: Callable[[DataFrame, int], DataFrame] | None = None, weight: float = 0.5) -> DataFrame:
    """query_id, text, doc_ids, documents: sparse and dense results of every planned query, merged, fused, best first.

    dense(queries, k) gives a run (query_id, doc_id, score, rank) for queries (query_id, text), whose ids
    are structs here; without it the sparse list stands alone. Texts are joined to the k results last, where they are
    while results are few.
    """
    asked = planned.select("query_id", F.posexplode("queries").alias("part", "q"))
    ids = asked.select(F.struct("query_id", "part").alias("query_id"), F.col("q").alias("text"))
    runs = [S.bm25(index or docs, ids, k), dense(ids, k) if dense else None]
    runs = [r if r is None else r.withColumn("parent_id", F.col("query_id.query_id")) for r in runs]
    fused = S.hybrid(runs[0], runs[1], k, weight)
    ranked = storage.write(fused.select("parent_id", "doc_id", "rank"), "retrieved")
    best = docs.select("doc_id", F.col("text").alias("doc")).join(F.broadcast(ranked) if ranked.count() <= S.BROADCAST_ROWS else ranked, "doc_id")
    lists = best.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "doc"))).alias("l"))
    out = planned.select("query_id", "text").join(lists, F.col("query_id") == F.col("parent_id"), "left")
    empty = F.coalesce("l", F.array().cast(lists.schema["l"].dataType))
    return out.select("query_id", "text", F.transform(empty, lambda x: x["doc_id"]).alias("doc_ids"), F.transform(empty, lambda x: x["doc"]).alias("documents"))


def answer(queries: DataFrame, docs: DataFrame, client: models.Client, prompts: dict[str, str] | None = None, k: int = 20, final_k: int = 10, index: S.Index | None = None, dense=None, weight: float = 0.5, **retry) -> DataFrame:
    """query_id, text, documents, answer, reference, rationale, status, error of queries (query_id, text). Plans are asked once and kept."""
    p = models.PROMPTS | (prompts or {})
    planned = storage.write(models.plan(queries, client, p["plan"], **retry), "planned")
    ranked = models.rerank(retrieve(planned, docs, k, index, dense, weight), client, p["rerank"], final_k, **retry)
    return models.generate(ranked.select("query_id", "text", "documents"), client, p["generate"], **retry)


def evaluate(answered: DataFrame, truths: DataFrame, client: models.Client, metrics: DataFrame | None = None, **retry) -> DataFrame:
    """query_id, the judged metrics and overall_quality; answers that failed have no row. The answers are made once and kept."""
    joined = answered.where("status = 'success' and size(documents) > 0").join(truths.select("query_id", "ground_truth"), "query_id", "left")
    judged = models.judge(storage.write(joined.withColumn("documents", F.slice("documents", 1, 3)), "answered"), client, **retry)
    if metrics is not None:
        judged = judged.join(metrics.select("query_id", F.col("precision").alias("p"), F.col("recall").alias("r")), "query_id", "left")
    else:
        judged = judged.withColumns({"p": F.lit(None).cast("double"), "r": F.lit(None).cast("double")})
    quality = C.end_to_end(F.col("p"), F.col("r"), F.col("context_precision"), F.col("context_recall"), F.col("faithfulness"), F.col("answer_accuracy"))
    return judged.select("query_id", *models.JUDGED, quality.alias("overall_quality"))


def optimise(seed: str, score: Callable[[str], DataFrame], propose: Callable[[str, DataFrame], str], rounds: int) -> tuple[str, list[tuple[str, float]]]:
    """The best prompt and all tried: each round proposes one from the best one's scores (query_id, score).

    A candidate replaces the best only if its mean is strictly higher. The loop is over prompts;
    every score is a distributed table.
    """

    def mean(df: DataFrame) -> float:
        return float(df.agg(F.avg("score").alias("m")).first().m or 0.0)

    best, best_scores = seed, score(seed).persist()
    best_mean = mean(best_scores)
    tried = [(seed, best_mean)]
    for _ in range(rounds):
        candidate = propose(best, best_scores)
        scores = score(candidate).persist()
        value = mean(scores)
        tried.append((candidate, value))
        if value > best_mean:
            best_scores.unpersist()
            best, best_scores, best_mean = candidate, scores, value
        else:
            scores.unpersist()
    best_scores.unpersist()
    return best, tried


def sweep(docs: DataFrame, queries: DataFrame, qrels: DataFrame, sizes: tuple[int, ...] = (256, 512, 1024, 2048), ratio: float = 0.1, k: int = 10, weight: float = 0.5, dense: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, rrf_k: int = S.RRF_K, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """chunk_size, chunk_overlap, num_chunks, avg_chunk_length and mean metrics of the first k, for every size, as one plan.

    Statistics, lists and metrics have chunk_size among their keys. Chunks overlap and come in every size, several times the
    texts: they are not kept, but found anew in the passes that statistics and scores take, as ranges of the texts' words.
    dense(chunks, queries, depth) gives a run (chunk_size, query_id, doc_id, score, rank) over chunks (chunk_size, doc_id,
    text, of), whose doc_id is the chunk's and ``of`` the document's; or vectors are those of documents (doc_id, embedding),
    which their chunks share, and of queries (query_id, embedding). Both lists are fused. Without either the sparse list
    stands alone. Queries without relevant chunks don't count.
    """
    settings = [(size, int(size * ratio)) for size in sizes]
    if any(size < overlap + chunking.BACK for size, overlap in settings):
        raise ValueError("chunk size must be at least the overlap and 100")
    source = storage.spread(docs)
    source = docs if source is docs else storage.write(source, "sweep-docs")  # a small table, dealt anew once
    worded = source.where("text is not null").select("doc_id", F.format_string("%s_chunk_", F.col("doc_id").cast("string")).alias("first"), swept.spaced(F.col("text")).alias("t"))
    counted = swept.counts(worded.select("doc_id", "t"), settings)
    found = swept.totals(counted, settings)
    chunks = counted.where("term is null").select("doc_id", "n")
    asked = storage.write(swept.ask(queries), "asked")
    texts = None
    if dense is not None or not swept.few(queries, asked, len(settings)):
        texts = chunking.sweep_table(source, settings).select("chunk_size", F.col("chunk_id").alias("doc_id"), F.col("chunk").alias("text"), F.col("doc_id").alias("of"))
    if swept.few(queries, asked, len(settings)):
        run = swept.bm25(worded.select("first", "t"), settings, queries, swept.weigh(counted, asked, found), found, 2 * k)
    else:
        run = S.bm25_by(texts.drop("of"), queries, "chunk_size", 2 * k, T.tokens_raw, positive_only=False)
    if dense is not None or vectors is not None:
        other = dense(texts, queries, 2 * k) if dense is not None else swept.by_documents(chunks, settings, *vectors, 2 * k)
        run = S.fuse(run, other, weight, k, ("chunk_size", "query_id"), normalise=False, rrf_k=rrf_k)
    relevant = swept.expand(qrels.join(chunks, "doc_id"), settings, "query_id").select("chunk_size", "query_id", "doc_id")
    names = ("ndcg", "precision", "recall", "mrr", "f1")
    means = E.rank_metrics(run, storage.write(relevant, "sweep-labels"), k, ("chunk_size",)).groupBy(F.col("chunk_size").alias("size")).agg(*[F.avg(m).alias(m) for m in names])
    every = [(size, overlap, of.n, of.characters / of.n if of.n else 0.0) for (size, overlap), of in zip(settings, found, strict=True)]  # one row a size
    every = docs.sparkSession.createDataFrame(every, "chunk_size int, chunk_overlap int, num_chunks long, avg_chunk_length double")
    found = every.join(means, F.col("chunk_size") == F.col("size"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return found.select("chunk_size", "chunk_overlap", "num_chunks", "avg_chunk_length", *[zero(m) for m in names])


def best_size(results: DataFrame) -> DataFrame:
    return results.orderBy(F.round("ndcg", 9).desc(), "chunk_size").limit(1)
