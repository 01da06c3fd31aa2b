"""A staged experiment: baseline, one prompt at a time, ablation on the test queries; every stage a table, and resumable.

A stage's scores are distributed tables (query_id, score, success, ...); the loops of the driver are over
prompts and stages alone. Prompts are arguments throughout: nothing is injected that must be restored.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import storage
from quarry.operators import bundles, feedback
from quarry.operators import evaluation as E
from quarry.operators import scoring as C
from quarry.operators import search as S
from quarry.plans import models, pareto, rag, reports
from quarry.sources import tables

MODULES = ("query_planner", "reranker", "generator")
STEP = {"query_planner": "plan", "reranker": "rerank", "generator": "generate"}
# Models that a step may ask, dimensions of embeddings by model, and the folders of an experiment, by what is written there.
MODELS = ("gpt-4o-mini", "gpt-4o", "gpt-5-nano", "gpt-5-mini")
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}
FOLDERS = {
    "checkpoint": "checkpoints", "metric": "metrics", "query_planner": "prompts/query_planner", "reranker": "prompts/reranker", "generator": "prompts/generator",
    "trace": "traces", "analysis": "analysis", "ablation": "ablations", "latex": "latex", "example": "per_example",
}
LEAST_BUDGET, FAILURE_SCORE = 100, 0.0


def dimension(model: str) -> int:
    """The length of a model's vectors; unknown models have that of the small one."""
    return DIMENSIONS.get(model, 1536)


@dataclass(frozen=True)
class Config:
    """An experiment's settings; its hash tells which checkpoints are its own."""

    name: str = "experiment"
    output: str = "experiments"
    n_queries: int = 100
    budget: int = 100
    model: str = MODELS[0]
    seed: int = 42
    train_ratio: float = 0.6
    val_ratio: float = 0.2
    test_ratio: float = 0.2
    chunk_size: int = 600
    chunk_overlap: int = 50
    retrieval_k: int = 20
    rerank_k: int = 10
    weight: float = 0.5
    search: str = "pareto"
    minibatch: int = pareto.MINIBATCH
    retry: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"unknown model {self.model}: one of {', '.join(MODELS)}")
        if self.train_ratio + self.val_ratio + self.test_ratio > 1 + 1e-9:
            raise ValueError("the shares of training, validation and test add up to more than 1")

    def settings(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("name", "output", "retry")}

    @property
    def id(self) -> str:
        return f"{self.name}_{tables.fingerprint(self.settings())[:8]}"

    @property
    def folder(self) -> str:
        return f"{self.output}/{self.id}"

    def at(self, what: str) -> str:
        """The folder of an experiment for one kind of result."""
        return f"{self.folder}/{FOLDERS[what]}"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))


# Prompts: a bundle is one file a module and version below a folder.


def save_prompts(spark: SparkSession, folder: str, prompts: dict[str, str], version: str = "v1") -> None:
    for module in MODULES:
        tables.write_text(spark, prompts.get(module, ""), f"{folder}/{module}/prompts/{version}.txt")


def load_prompts(spark: SparkSession, folder: str, version: str = "v1") -> dict[str, str]:
    return {m: tables.read_text(spark, f"{folder}/{m}/prompts/{version}.txt").rstrip("\x00") for m in MODULES}


def with_prompt(prompts: dict[str, str], module: str, prompt: str) -> dict[str, str]:
    """The prompts with one replaced; an unknown module is an error."""
    if module not in MODULES:
        raise ValueError(f"unknown module: {module}")
    return prompts | {module: prompt}


def default_prompts() -> dict[str, str]:
    return {m: models.PROMPTS[STEP[m]] for m in MODULES}


def first_queries(queries: DataFrame, n: int) -> DataFrame:
    """The n queries of the smallest ids: a table has no order of its own."""
    return queries.orderBy("query_id").limit(n)


@dataclass(frozen=True)
class Corpus:
    """What queries run against: documents (doc_id, text), their index, labels (query_id, doc_id), truths (query_id, ground_truth), and a dense search or none."""

    docs: DataFrame
    index: S.Index
    qrels: DataFrame
    truths: DataFrame
    dense: Callable[[DataFrame, int], DataFrame] | None = None

    @classmethod
    def build(cls, docs: DataFrame, qrels: DataFrame, truths: DataFrame, dense=None) -> Corpus:
        return cls(docs, S.Index.build(docs), qrels, truths, dense)


# One step alone, and a query's context: failed steps leave their fallback, a status and a message.


def run_planner(queries: DataFrame, client, prompts: dict[str, str], config: Config) -> DataFrame:
    return models.plan(queries, client, prompts["query_planner"], **config.retry)


def run_retrieval(planned: DataFrame, corpus: Corpus, config: Config) -> DataFrame:
    return rag.retrieve(planned, corpus.docs, config.retrieval_k, corpus.index, corpus.dense, config.weight)


def run_reranker(lists: DataFrame, client, prompts: dict[str, str], config: Config) -> DataFrame:
    return models.rerank(lists, client, prompts["reranker"], config.rerank_k, **config.retry)


def run_generator(contexts: DataFrame, client, prompts: dict[str, str], config: Config) -> DataFrame:
    return models.generate(contexts.select("query_id", "text", "documents"), client, prompts["generator"], **config.retry)


def contexts(queries: DataFrame, corpus: Corpus, client, prompts: dict[str, str], config: Config) -> DataFrame:
    """query_id, text, listed, doc_ids, documents, status, error for every query: planned, retrieved, reranked; none is lost.

    listed has the ids before reranking. A query whose planner or reranker failed has status error and its first message.
    """
    planned = storage.write(run_planner(queries, client, prompts, config), "planned")
    lists = storage.write(run_retrieval(planned, corpus, config), "lists")
    ranked = run_reranker(lists, client, prompts, config).select("query_id", "doc_ids", "documents", F.col("status").alias("s"), F.col("error").alias("e"))
    first = planned.select("query_id", "text", F.col("status").alias("s0"), F.col("error").alias("e0"))
    joined = first.join(lists.select("query_id", F.col("doc_ids").alias("listed")), "query_id", "left").join(ranked, "query_id", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    ids, texts = lists.schema["doc_ids"].dataType, lists.schema["documents"].dataType
    bad = (F.col("s0") == "error") | (F.coalesce("s", F.lit("error")) == "error")
    out = joined.select(
        "query_id", "text", empty(F.col("listed"), ids).alias("listed"), empty(F.col("doc_ids"), ids).alias("doc_ids"), empty(F.col("documents"), texts).alias("documents"),
        F.when(bad, "error").otherwise("success").alias("status"), F.coalesce("e0", "e").alias("error"),
    )
    return storage.write(out, "contexts")


def as_run(lists: DataFrame, column: str = "doc_ids") -> DataFrame:
    """query_id, doc_id, rank of an array of ids a query."""
    return lists.select("query_id", F.posexplode(column).alias("rank", "doc_id")).select("query_id", "doc_id", (F.col("rank") + 1).alias("rank"))


def evaluate_split(found: DataFrame, corpus: Corpus, client, prompts: dict[str, str], config: Config) -> DataFrame:
    """query_id, the judged metrics, overall_quality, for the queries that have a context and an answer."""
    answered = run_generator(found, client, prompts, config)
    metrics = E.rank_metrics(as_run(found, "listed"), corpus.qrels)
    return storage.write(rag.evaluate(answered, corpus.truths, client, metrics, **config.retry), "evaluated")


def summary(scores: DataFrame, value: str, description: str, split: str) -> dict:
    """The record of a split: how many, mean, deviation, interval, and the means and deviations of all metrics."""
    s = E.interval(scores, value).first()
    numbers = [c for c, kind in scores.dtypes if kind == "double"]
    means = scores.agg(*[F.avg(c).alias(f"mean_{c}") for c in numbers], *[F.stddev_samp(c).alias(f"std_{c}") for c in numbers]).first().asDict() if numbers else {}
    known = {k: v for k, v in means.items() if v is not None}
    return {"description": description, "split": split, "n_examples": s.n, "mean_score": s["mean"] or 0.0, "std_score": s["std"], "ci_lower": s.ci_low or 0.0, "ci_upper": s.ci_high or 0.0, "metrics": known}


# Adapters: how a module is run and scored over a batch with a candidate prompt, and what is told of it.


class Adapter(Protocol):
    module: str

    def run(self, batch: DataFrame, prompts: dict[str, str]) -> DataFrame: ...  # query_id, ..., status
    def score(self, ran: DataFrame) -> DataFrame: ...  # query_id, score, metrics
    def record(self, scored: DataFrame) -> DataFrame: ...  # query_id, record


@dataclass(frozen=True)
class _Adapter:
    corpus: Corpus
    client: models.Client
    config: Config
    prompts: dict[str, str]
    module: str = ""
    failure_score: float = FAILURE_SCORE
    primary: str = "ndcg"

    def candidate(self) -> dict[str, str]:
        return {self.module: self.prompts[self.module]}

    def _of(self, prompts: dict[str, str]) -> dict[str, str]:
        return self.prompts | prompts

    def evaluate(self, batch: DataFrame, prompts: dict[str, str]) -> DataFrame:
        """Every row of the batch with score, success and error; a row that failed has failure_score."""
        ran = storage.write(self.run(batch, self._of(prompts)), "ran")
        scored = self.score(ran.where("status = 'success'"))
        joined = ran.join(scored, "query_id", "left")
        ok = F.col("score").isNotNull()
        return storage.write(joined.withColumns({"success": ok, "score": F.coalesce("score", F.lit(self.failure_score))}), "batch")

    def reflective(self, scored: DataFrame, components: list[str]) -> DataFrame | None:
        """query_id, record of the rows that succeeded, if this module is to be updated."""
        return self.record(scored.where("success")) if self.module in components else None


class PlannerAdapter(_Adapter):
    """A plan is worth what its queries find: ndcg, mrr or f1; one half without labels."""

    def run(self, batch, prompts):
        planned = storage.write(run_planner(batch, self.client, prompts, self.config), "planned")
        lists = run_retrieval(planned, self.corpus, self.config)
        return lists.join(planned.select("query_id", "queries", "mode", "status"), "query_id")

    def score(self, ran):
        m = E.rank_metrics(as_run(ran), self.corpus.qrels)
        got = bundles.retrieval(as_run(ran), self.corpus.qrels).select("query_id", "chunks_hit", "chunks_relevant")
        return ran.select("query_id").join(m, "query_id", "left").join(got, "query_id", "left").withColumn("score", C.planner_score(F.col(self.primary)))

    def record(self, scored):
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        words = F.array_distinct(F.split(F.lower("text"), r"\s+"))
        asked = F.array_distinct(F.flatten(F.transform("queries", lambda q: F.split(F.lower(q), r"\s+"))))
        coverage = F.size(F.array_intersect(words, asked)) / F.size(words)
        sets = F.transform("queries", lambda q: F.array_distinct(F.split(F.lower(q), r"\s+")))
        pairs = F.flatten(F.transform(sets, lambda a, i: F.transform(F.slice(sets, i + 2, F.size(sets)), lambda b: 1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))))
        diversity = F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)).otherwise(0.0)
        p, r, hit, due = zero(F.col("precision")), zero(F.col("recall")), F.coalesce("chunks_hit", F.lit(0)), F.coalesce("chunks_relevant", F.lit(0))
        told = feedback.planner(F.col("score"), p, r, hit, due, F.col("mode"), F.size("queries"), diversity, coverage)
        return scored.select("query_id", feedback.planner_record(F.col("text"), F.col("mode"), F.col("queries"), diversity, coverage, hit, due, p, r, zero(F.col("ndcg")), F.col("score"), told).alias("record"))


class RerankerAdapter(_Adapter):
    """A list is worth its ranks: .6 ndcg, .2 mrr, .2 precision at 5; without labels one half."""

    def run(self, batch, prompts):
        planned = run_planner(batch, self.client, prompts, self.config)
        lists = storage.write(run_retrieval(planned, self.corpus, self.config), "lists")
        before = lists.select("query_id", F.col("doc_ids").alias("listed"), F.col("documents").alias("before"))
        return run_reranker(lists, self.client, prompts, self.config).join(before, "query_id")

    def score(self, ran):
        m = E.rank_metrics(as_run(ran), self.corpus.qrels).join(E.metrics_at(as_run(ran), self.corpus.qrels, (5,)).select("query_id", "precision_at_5"), "query_id")
        ranked = C.reranker_score(F.col("ndcg"), F.col("mrr"), F.col("precision_at_5"))
        score = F.when((F.col("ndcg") == 0) & (F.col("precision") > 0), F.col("f1")).otherwise(ranked)
        return ran.select("query_id").join(m.withColumn("score", score), "query_id", "left").withColumn("score", F.coalesce("score", F.lit(0.5)))

    def record(self, scored):
        from quarry.operators import answers as A

        zero = lambda c: F.coalesce(c, F.lit(0.0))
        moved = F.transform("doc_ids", lambda d, i: F.abs(F.array_position("listed", d) - 1 - i).cast("double"))
        change = F.when(F.size(moved) > 0, F.aggregate(moved, F.lit(0.0), lambda s, x: s + x) / F.size(moved)).otherwise(0.0)
        top = F.array_distinct(F.flatten(F.transform(F.slice("documents", 1, 5), lambda d: F.split(F.lower(d), r"\s+"))))
        bias, overlap = A.length_bias(F.col("documents")), A.share(A.word_set(F.col("text")), top)
        told = feedback.reranker(F.col("score"), zero(F.col("ndcg")), zero(F.col("mrr")), zero(F.col("precision_at_5")), bias, overlap, change)
        return scored.select("query_id", feedback.reranker_record(F.col("text"), F.col("before"), F.col("documents"), change, bias, overlap, F.col("score"), told).alias("record"))


class GeneratorAdapter(_Adapter):
    """An answer is worth the mean of its faithfulness and accuracy."""

    def run(self, batch, prompts):
        return run_generator(contexts(batch, self.corpus, self.client, prompts, self.config), self.client, prompts, self.config)

    def score(self, ran):
        asked = ran.join(self.corpus.truths.select("query_id", "ground_truth"), "query_id", "left")
        judged = models.judge(asked, self.client, **self.config.retry).where("status <> 'error'")
        return bundles.generator(judged.select("query_id", *models.JUDGED)).withColumn("score", F.col("generation_quality"))

    def record(self, scored):
        from quarry.operators import answers as A

        context = F.array_join("documents", "\n\n")
        f, a = F.col("faithfulness"), F.col("answer_accuracy")
        usage, addressed = A.share(A.word_set(F.col("answer"), 4), A.word_set(context, 4)), A.addressing(F.col("text"), F.col("answer"))
        told = feedback.generator(F.col("score"), f, a, usage, addressed, A.hedging(F.col("answer")), A.specific(F.col("answer")))
        return scored.select("query_id", feedback.generator_record(F.col("text"), context, F.col("answer"), f, a, F.col("score"), told).alias("record"))


ADAPTERS = {"query_planner": PlannerAdapter, "reranker": RerankerAdapter, "generator": GeneratorAdapter}


def adapter(module: str, corpus: Corpus, client, config: Config, prompts: dict[str, str], **more) -> _Adapter:
    """The adapter of a module; the planner's metric is one of ndcg, mrr and f1."""
    if more.get("primary", "ndcg") not in ("ndcg", "mrr", "f1"):
        raise ValueError("the planner's metric is ndcg, mrr or f1")
    return ADAPTERS[module](corpus, client, config, prompts, module, **more)


def _greedy(of: _Adapter, train: DataFrame, n_train: int, n_val: int, propose: Callable[[str, DataFrame], str], budget: int) -> tuple[str, list[dict]]:
    """The best prompt by the training rows' mean, and what was tried: each candidate comes from the best one's records."""
    best, best_scores, spent, tried = of.prompts[of.module], of.evaluate(train, {of.module: of.prompts[of.module]}), n_train, []
    best_mean = E.interval(best_scores, "score").first()["mean"] or 0.0
    while n_train and spent + n_train + n_val <= budget:
        prompt = propose(best, of.reflective(best_scores, [of.module]))
        scores = of.evaluate(train, {of.module: prompt})
        mean = E.interval(scores, "score").first()["mean"] or 0.0
        spent += n_train
        tried.append({"iteration": len(tried) + 1, "prompt": prompt, "score": mean, "accepted": mean > best_mean})
        if mean > best_mean:
            best, best_mean, best_scores = prompt, mean, scores
    return best, tried


SEARCHES = ("pareto", "greedy")


def optimise_module(of: _Adapter, train: DataFrame, validation: DataFrame, propose: Callable[[str, DataFrame], str], budget: int, search: str = "greedy", minibatch: int = pareto.MINIBATCH, seed: int = 42) -> dict:
    """The record of a module's search for a better prompt.

    propose(prompt, records) gives a candidate from reflections on training rows. Every evaluation of a
    row counts against the budget (below 100 it is too small to tell much). "pareto" draws parents from the
    frontier of a pool and tries candidates on minibatches first; "greedy" climbs by the mean of all
    training rows. The best candidate replaces the seed only if it is strictly better on the validation rows.
    """
    if search not in SEARCHES:
        raise ValueError(f"unknown search {search}: one of {', '.join(SEARCHES)}")
    began, first, more = time.time(), of.prompts[of.module], {}
    base = of.evaluate(validation, {of.module: first})
    base_mean = E.interval(base, "score").first()["mean"] or 0.0
    if search == "pareto":
        pool = pareto.search(of, first, train, validation, propose, budget, minibatch, random_seed=seed)
        best, tried = pool.prompts[pool.best], pool.steps
        more = {"candidates": [{"prompt": p, "parent": c, "mean": m} for p, c, m in zip(pool.prompts, pool.came_from, pool.means, strict=True)], "spent": pool.spent}
    else:
        best, tried = _greedy(of, train, train.count(), validation.count(), propose, budget)
    found = of.evaluate(validation, {of.module: best}) if best != first else base
    mean = E.interval(found, "score").first()["mean"] or 0.0
    reverted = best != first and not mean > base_mean
    if reverted:
        best, found, mean = first, base, base_mean
    ci = {k: E.interval(x, "score").first() for k, x in (("baseline", base), ("best", found))}
    both = found.select("query_id", F.col("score").alias("a")).join(base.select("query_id", F.col("score").alias("b")), "query_id")
    t = E.paired_t(both, "a", "b").first()
    return {
        "module": of.module, "seed_prompt": first, "best_prompt": best, "baseline": base_mean, "best": mean, "reverted": reverted, "low_budget": budget < LEAST_BUDGET, "seconds": time.time() - began,
        **{f"{k}_ci_lower": x.ci_low for k, x in ci.items()}, **{f"{k}_ci_upper": x.ci_high for k, x in ci.items()}, "improvement": mean - base_mean,
        "improvement_pct": (mean - base_mean) / base_mean * 100 if base_mean > 0 else 0.0, "t_stat": t.t_stat, "p_value": t.p_approx, "is_significant": t.p_approx < 0.05, "iterations": tried, "accepted": sum(x["accepted"] for x in tried),
        "search": search, **more,
    }


def ablation_configs(seed: dict[str, str], best: dict[str, str]) -> dict[str, dict[str, str]]:
    """Four sets of prompts: the seeds, then one more module's best at a time."""
    sets, now = {"baseline": seed}, dict(seed)
    for name, module in (("M1_only", "query_planner"), ("M1+M2", "reranker"), ("M1+M2+M3", "generator")):
        now = with_prompt(now, module, best[module])
        sets[name] = now
    return sets


def run_configurations(configs: dict[str, dict[str, str]], test: DataFrame, corpus: Corpus, client, config: Config) -> DataFrame:
    """config, query_id, the judged metrics, overall_quality of every configuration (a set of prompts) over the test rows, as one plan.

    A step's rows are keyed by the prompts that it depends on: the planner's by its own, the reranker's by
    both, the answer's by all three. Configurations that begin with the same prompts share those rows, so no
    step is asked twice for the same prompts and query.
    """
    spark, known = test.sparkSession, sorted({p[m] for p in configs.values() for m in MODULES})
    number = {text: f"p{i}" for i, text in enumerate(known)}
    every = spark.createDataFrame([(name, *[number[p[m]] for m in MODULES]) for name, p in configs.items()], "config string, planner string, ranker string, writer string")
    prompts = spark.createDataFrame([(number[t], t) for t in known], "number string, prompt string")
    steps = ("planner", "ranker", "writer")

    def asked(rows: DataFrame, depth: int) -> DataFrame:
        """rows for each distinct run of a step, with its prompt and a key."""
        of, before = list(steps[: depth + 1]), list(steps[:depth])
        runs = every.select(*of).distinct().join(prompts, F.col(of[-1]) == F.col("number")).drop("number")  # a row a set of prompts
        met = rows.join(F.broadcast(runs), before) if before else rows.crossJoin(F.broadcast(runs))
        return met.withColumn("key", F.concat_ws(":", *of, F.col("query_id").cast("string")))

    def answered(step: DataFrame, name: str, **columns) -> DataFrame:
        return storage.write(step.select(F.col("query_id").alias("key"), *[F.col(c).alias(n) for n, c in columns.items()]), name)

    keyed = lambda rows, *more: rows.select(F.col("key").alias("query_id"), "text", *more, "prompt")
    first = storage.write(asked(test.select("query_id", "text"), 0), "asked")
    planned = storage.write(models.plan(keyed(first), client, None, **config.retry), "planned")
    lists = answered(run_retrieval(planned, corpus, config), "lists", listed="doc_ids", before="documents")
    plans = planned.select(F.col("query_id").alias("key"), F.col("status").alias("planned"))
    second = storage.write(asked(first.drop("prompt").join(lists, "key").join(plans, "key").drop("key"), 1), "to-rank")
    lists_of = second.withColumnsRenamed({"listed": "doc_ids", "before": "documents"})
    ranked = answered(models.rerank(keyed(lists_of, "doc_ids", "documents"), client, None, config.rerank_k, **config.retry), "ranked", documents="documents")
    third = storage.write(asked(second.drop("prompt", "before").join(ranked, "key").drop("key"), 2), "to-answer")
    written = storage.write(models.generate(keyed(third, "documents"), client, None, **config.retry), "written")
    run = lists.join(first.select("key", "planner", "query_id"), "key").select("planner", "query_id", F.posexplode("listed").alias("rank", "doc_id"))
    metrics = E.rank_metrics(run.withColumn("rank", F.col("rank") + 1), corpus.qrels, by=("planner",))
    keys = third.select("key", "planner", "query_id")
    truths = keys.join(corpus.truths, "query_id").select(F.col("key").alias("query_id"), "ground_truth")
    found = metrics.join(keys, ["planner", "query_id"]).select(F.col("key").alias("query_id"), "precision", "recall")
    judged = storage.write(rag.evaluate(written, truths, client, found, **config.retry).withColumnRenamed("query_id", "key"), "judged")
    told = third.select("key", *steps, "query_id").join(judged, "key").drop("key")
    return every.join(told, list(steps)).drop(*steps)


def ablate(configs: dict[str, dict[str, str]], test: DataFrame, corpus: Corpus, client, config: Config) -> tuple[DataFrame, DataFrame]:
    """(one row a config, in their order: score, interval, gain and test against the first; scores by config and query). Queries are paired by id."""
    told = run_configurations(configs, test, corpus, client, config)
    scores = storage.write(told.select("config", "query_id", F.col("overall_quality").alias("score")), "ablation")
    base = scores.where(F.col("config") == next(iter(configs))).select("query_id", F.col("score").alias("b"))
    i = E.interval(scores, "score", ("config",)).withColumnRenamed("config", "c")
    t = E.paired_t(scores.withColumnRenamed("score", "a").join(base, "query_id"), "a", "b", ("config",)).withColumnRenamed("config", "d")
    order = test.sparkSession.createDataFrame([*enumerate(configs)], "place int, config string")  # one row a config
    rows = order.join(i, F.col("config") == F.col("c"), "left").join(t, F.col("config") == F.col("d"), "left").crossJoin(base.agg(F.coalesce(F.avg("b"), F.lit(0.0)).alias("base")))
    score, p = F.coalesce("mean", F.lit(0.0)), F.coalesce("p_approx", F.lit(1.0))
    low, high = F.coalesce("ci_low", F.lit(0.0)), F.coalesce("ci_high", F.lit(0.0))
    out = rows.orderBy("place").select("config", score.alias("score"), low.alias("ci_low"), high.alias("ci_high"), (score - F.col("base")).alias("gain"), F.coalesce("t_stat", F.lit(0.0)).alias("t_stat"), p.alias("p_value"), (p < 0.05).alias("is_significant"))
    return out, scores


def run(spark: SparkSession, config: Config, queries: DataFrame, corpus: Corpus, client, propose: Callable[[str, DataFrame], str], seed: dict[str, str] | None = None, resume_from: int = 0) -> dict:
    """The state after the last stage: 0 baseline, 1 planner, 2 reranker, 3 generator, 4 ablation and reports.

    Every stage's state (prompts, records, splits by id) is a checkpoint of the configuration; with
    resume_from the stages before it are read, or all run again where there is none. Each module is
    searched with the best prompts of those before it, whose contexts are made anew.
    """
    asked = E.split(first_queries(queries, config.n_queries), config.seed, (config.train_ratio, config.val_ratio))
    at = config.at("checkpoint")
    state = tables.load_checkpoint(spark, at, resume_from - 1, config.settings()) if resume_from > 0 else None
    start = resume_from if state else 0
    ids = state["ids"] if state else {s: [str(r.query_id) for r in asked.where(F.col("split") == s).select("query_id").collect()] for s in ("train", "validation", "test")}
    of = {s: tables.restore_queries(queries, ids[s]).drop("place") for s in ids}
    if start <= 0:
        prompts = seed or default_prompts()
        found = evaluate_split(contexts(of["validation"], corpus, client, prompts, config), corpus, client, prompts, config)
        state = {"ids": ids, "seed": prompts, "prompts": prompts, "baseline": summary(found, "overall_quality", "baseline", "validation"), "modules": []}
        save_prompts(spark, f"{config.folder}/prompts", prompts, "seed")
        tables.save_checkpoint(spark, at, 0, state, config.settings())
    for phase, module in enumerate(MODULES, 1):
        if start <= phase:
            made = adapter(module, corpus, client, config, state["prompts"])
            record = optimise_module(made, of["train"], of["validation"], propose, config.budget, config.search, config.minibatch, config.seed)
            state = {**state, "prompts": with_prompt(state["prompts"], module, record["best_prompt"]), "modules": [*state["modules"], record]}
            tables.write_text(spark, record["best_prompt"], f"{config.at(module)}/best.txt")
            tables.save_checkpoint(spark, at, phase, state, config.settings())
    if start <= 4:
        sets = ablation_configs(state["seed"], state["prompts"])
        table, scores = ablate(sets, of["test"], corpus, client, config)
        table = storage.write(table, "ablation-table")
        save_prompts(spark, f"{config.folder}/prompts", state["prompts"], "best")
        state = {**state, "ablation": sorted((r.asDict() for r in table.collect()), key=lambda r: list(sets).index(r["config"]))}
        report(spark, config, state, table, scores)
        tables.save_checkpoint(spark, at, 4, state, config.settings())
    return state


def report(spark: SparkSession, config: Config, state: dict, ablation: DataFrame, scores: DataFrame) -> None:
    """summary.json; in their folders the module and ablation tables as CSV, LaTeX and JSON, the configuration as LaTeX, each search's trace, scores by example."""
    modules = spark.createDataFrame(
        [tuple(r[k] for k in ("module", "baseline", "baseline_ci_lower", "baseline_ci_upper", "best", "best_ci_lower", "best_ci_upper", "t_stat", "p_value", "is_significant")) for r in state["modules"]],
        "module string, baseline double, baseline_ci_lower double, baseline_ci_upper double, best double, best_ci_lower double, best_ci_upper double, t_stat double, p_value double, is_significant boolean",
    )
    module_table, ablation_table = reports.module_table(modules), reports.ablation_table(ablation)
    settings = spark.createDataFrame([(k, str(v)) for k, v in config.settings().items()], "Setting string, Value string")
    for name, table in (("module_results", module_table), ("ablation_results", ablation_table)):
        reports.write_csv(table, f"{config.at('metric')}/{name}.csv")
    for name, table, caption in (("modules", module_table, "Modules"), ("ablation", ablation_table, "Ablation"), ("config", settings, "Configuration")):
        tables.write_text(spark, reports.latex(table, caption, f"tab:{name}"), f"{config.at('latex')}/{name}.tex")
    reports.write_examples(scores, config.at("example"))
    for record in state["modules"]:
        reports.write_json(spark, {k: record[k] for k in ("module", "search", "iterations", "candidates") if k in record}, f"{config.at('trace')}/{record['module']}.json")
    told = ("module", "baseline", "best", "improvement", "improvement_pct", "t_stat", "p_value", "is_significant", "reverted", "accepted")
    reports.write_json(spark, [{k: r[k] for k in told} for r in state["modules"]], f"{config.at('analysis')}/modules.json")
    reports.write_json(spark, state["ablation"], f"{config.at('ablation')}/ablation.json")
    brief = {"experiment": config.id, "config": config.settings(), "baseline": state["baseline"], "ablation": state["ablation"], "modules": [{k: v for k, v in r.items() if k not in ("iterations", "seed_prompt", "best_prompt")} for r in state["modules"]]}
    reports.write_json(spark, brief, f"{config.folder}/summary.json")


def options(args: list[str] | None = None) -> tuple[Config, argparse.Namespace]:
    """The command line as a configuration, and what else it says."""
    p = argparse.ArgumentParser(description="A staged search for better prompts")
    p.add_argument("--experiment_name", default="experiment")
    p.add_argument("--output_dir", default="experiments")
    p.add_argument("--data_path", default="data/train")
    p.add_argument("--resume_from", type=int, default=0)
    p.add_argument("--model", default=MODELS[0])
    p.add_argument("--chunk_size_config")
    for name, kind, default in (("n_queries", int, 100), ("budget", int, 100), ("seed", int, 42), ("train_ratio", float, 0.6), ("val_ratio", float, 0.2), ("test_ratio", float, 0.2), ("max_concurrent", int, models.CONCURRENT), ("chunk_size", int, 600), ("chunk_overlap", int, 50), ("retrieval_k", int, 20), ("rerank_k", int, 10)):
        p.add_argument(f"--{name}", type=kind, default=default)
    a = p.parse_args(args)
    known = ("n_queries", "budget", "model", "seed", "train_ratio", "val_ratio", "test_ratio", "chunk_size", "chunk_overlap", "retrieval_k", "rerank_k")
    return Config(a.experiment_name, a.output_dir, **{k: getattr(a, k) for k in known}, retry={"concurrent": a.max_concurrent}), a


def load(spark: SparkSession, config: Config, a: argparse.Namespace) -> tuple[Config, DataFrame, Corpus]:
    """The configuration (with the chunk size of a sweep's report, if one is named), the queries, and the indexed chunks of the JSON files below data_path."""
    if a.chunk_size_config:
        size, overlap = tables.read_chunk_size(spark, a.chunk_size_config, config.chunk_size, config.chunk_overlap)
        config = replace(config, chunk_size=size, chunk_overlap=overlap)
    raw = tables.read_queries(spark, f"{a.data_path}/queries.json")
    chunks = storage.write(tables.chunk_documents(tables.read_documents(spark, f"{a.data_path}/documents.json"), config.chunk_size, config.chunk_overlap), "chunks")
    qrels = tables.resolve_labels(raw, chunks).withColumnRenamed("chunk_id", "doc_id")
    docs = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("chunk").alias("text"))
    return config, raw.select("query_id", F.col("query").alias("text")), Corpus.build(docs, qrels, raw.select("query_id", "ground_truth"))


def main(args: list[str] | None = None, client=None, propose: Callable[[str, DataFrame], str] | None = None) -> dict:
    """The experiment from the command line; without a client answers come by rules, without propose prompts stay."""
    config, a = options(args)
    spark = SparkSession.builder.getOrCreate()
    config, queries, corpus = load(spark, config, a)
    return run(spark, config, queries, corpus, client or models.RuleClient(), propose or (lambda prompt, records: prompt), resume_from=a.resume_from)


if __name__ == "__main__":
    print(json.dumps(main()["baseline"]))
