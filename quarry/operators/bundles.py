"""Evaluations of one step each: what a planner, a retriever, a reranker or a generator did, as columns by query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import answers as A
from quarry.operators import scoring as C
from quarry.operators.evaluation import f1, metrics_at, rank_metrics


def planner(planned: DataFrame) -> DataFrame:
    """query_id, num_queries, is_decomposition of plans (query_id, mode, queries)."""
    return planned.select("query_id", F.size("queries").cast("long").alias("num_queries"), F.when(F.col("mode") == "decomposition", 1.0).otherwise(0.0).alias("is_decomposition"))


def context_ids(retrieved: Column, relevant: Column) -> dict[str, Column]:
    """Precision and recall of two arrays of ids, as sets; 0 where a set is empty."""
    return {"id_precision": A.share(F.array_distinct(retrieved), relevant), "id_recall": A.share(F.array_distinct(relevant), retrieved)}


def retrieval(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query that has labels and results: precision, recall and F1 over the sets, how many were retrieved, relevant and hit, and the id-based pair."""
    found = run.groupBy("query_id").agg(F.collect_set("doc_id").alias("got"))
    due = qrels.groupBy("query_id").agg(F.collect_set("doc_id").alias("due"))
    both = found.join(due, "query_id")  # lists of k, and an item's labels
    hits = F.size(F.array_intersect("got", "due"))
    p, r = hits / F.size("got"), hits / F.size("due")
    ids = context_ids(F.col("got"), F.col("due"))
    return both.select(
        "query_id", p.alias("retrieval_precision"), r.alias("retrieval_recall"), f1(p, r).alias("retrieval_f1"),
        F.size("got").cast("long").alias("chunks_retrieved"), F.size("due").cast("long").alias("chunks_relevant"), hits.cast("long").alias("chunks_hit"), *[c.alias(n) for n, c in ids.items()],
    )


def reranker(before: DataFrame, after: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Metrics of a reranked run, and by how much (and how many percent) ndcg, mrr and precision at 5 are above those of the run before."""
    judged = lambda run: rank_metrics(run, qrels).select("query_id", "ndcg", "mrr").join(metrics_at(run, qrels, ks), "query_id")
    new, old = judged(after), judged(before).select("query_id", *[F.col(c).alias(f"old_{c}") for c in ("ndcg", "mrr", "precision_at_5")])
    gains = []
    for c in ("ndcg", "mrr", "precision_at_5"):
        gains += [(F.col(c) - F.col(f"old_{c}")).alias(f"{c}_improvement"), C.improvement_pct(F.col(f"old_{c}"), F.col(c)).alias(f"{c}_improvement_pct")]
    return new.join(old, "query_id").select(*new.columns, *gains)


def generator(judged: DataFrame) -> DataFrame:
    """judged (query_id, faithfulness, answer_accuracy) with generation_quality, the mean of both."""
    return judged.withColumn("generation_quality", C.generation_quality(F.col("faithfulness"), F.col("answer_accuracy")))


def contexts(judged: DataFrame) -> DataFrame:
    """judged (query_id, context_precision, context_recall) of lists before reranking, with context_f1; a missing one is 0."""
    p, r = (F.coalesce(c, F.lit(0.0)) for c in ("context_precision", "context_recall"))
    return judged.withColumns({"context_precision": p, "context_recall": r, "context_f1": f1(p, r)})


def generation_basic(answer: Column, truth: Column, context: Column) -> dict[str, Column]:
    """Length, length against the context, and the shares of the answer's words in the context and of the truth's in the answer."""
    words, none = A.word_set, F.lit(0.0)
    return {
        "answer_length": F.length(answer).cast("long"),
        "answer_length_ratio": F.when(F.length(context) > 0, F.length(answer) / F.length(context)).otherwise(none),
        "context_term_overlap": A.share(words(answer), words(context)),
        "ground_truth_term_overlap": A.share(words(F.coalesce(truth, F.lit(""))), words(answer)),
    }


def batch_summary(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean_score, success_rate, n_errors of a batch (score, success); an empty batch scores 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), zero(F.avg("score")).alias("mean_score"), zero(F.avg(F.col("success").cast("double"))).alias("success_rate"), F.count_if(~F.col("success")).alias("n_errors"),
    )


class Evaluator(Protocol):
    """What judges a kind of step: tables in, one row a query out."""

    kind: str

    def evaluate(self, *frames: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Judged:
    """An evaluator made of a function of tables, of which the first has a row a query."""

    kind: str
    of: Callable[..., DataFrame]
    frames: int  # how many tables it takes

    def evaluate(self, *frames: DataFrame) -> DataFrame:
        if len(frames) != self.frames:
            raise ValueError(f"{self.kind} is judged by {self.frames} tables, not {len(frames)}")
        return self.of(*frames)


#: What evaluates each kind of step; register adds to it.
KINDS: dict[str, Evaluator] = {e.kind: e for e in (Judged("query_planner", planner, 1), Judged("retrieval", retrieval, 2), Judged("reranker", reranker, 3), Judged("generator", generator, 1))}


def register(evaluator: Evaluator) -> None:
    """An evaluator for a new kind of step; a kind that there is already is an error."""
    if evaluator.kind in KINDS:
        raise ValueError(f"{evaluator.kind} has an evaluator")
    KINDS[evaluator.kind] = evaluator


def evaluate(kind: str, *frames: DataFrame) -> DataFrame:
    """The evaluation of a kind of step; of an unknown kind the rows without metrics."""
    return KINDS[kind].evaluate(*frames) if kind in KINDS else frames[0].select("query_id")
