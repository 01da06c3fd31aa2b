"""Steps that ask a model, as maps over partitions: plan, contextualise, embed, rerank, generate, judge.

A client is any object with ``ask(task, prompt, text) -> dict`` that can be pickled; RuleClient is one
without a model, for tests and dry runs. A row whose call fails after the retries keeps the step's
fallback, a status of "error" and the message: no row is lost, and Spark may repeat any task.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Prompts of our own; any text with the same fields will do.
PROMPTS = {
    "plan": "Write one or more search queries for the question.",
    "rerank": "Order the {num_documents} documents by how well they answer: {query}",
    "generate": "Answer {query} from this context alone:\n{context}",
    "context": "Say in one sentence where this part stands in its document.\n{document}\n---\n{chunk}",
    "judge": "Give faithfulness, answer_accuracy, context_precision and context_recall from 0 to 1.",
}
JUDGED = ("faithfulness", "answer_accuracy", "context_precision", "context_recall")
#: Calls at once in a task.
CONCURRENT = 10


class Client(Protocol):
    def ask(self, task: str, prompt: str, text: str) -> dict: ...


# What a passing failure's message holds.
PASSING = ("429", "rate limit", "connection", "timeout")


def retryable(problem: Exception) -> bool:
    """Whether another try may help: limits of a service and broken connections, not faults of a program."""
    told = str(problem).lower()
    return isinstance(problem, ConnectionError | TimeoutError) or any(x in told for x in PASSING)


def with_retry(call: Callable, tries: int = 5, delay: float = 1.0, most: float = 60.0, factor: float = 2.0, sleep: Callable = time.sleep, again: Callable[[Exception], bool] = retryable):
    """call(), and after a failure that may pass again, with growing delays; the last failure is raised."""
    for attempt in range(tries):
        try:
            return call()
        except Exception as problem:
            if attempt == tries - 1 or not again(problem):
                raise
            sleep(min(most, delay * factor**attempt))


def _words(text: str) -> set[str]:
    return set(re.findall(r"\w+", text.lower()))


class RuleClient:
    """Answers by rules: splits questions, orders by shared words, quotes the best sentence, scores by shared words."""

    def ask(self, task: str, prompt: str, text: str) -> dict:
        asked = json.loads(text)
        if task == "plan":
            parts = [p.strip() for p in re.split(r"[?;]", asked["query"]) if p.strip()]
            return {"mode": "decomposition" if len(parts) > 1 else "reformulation", "query": parts or asked["query"]}
        if task == "rerank":
            wanted = _words(asked["query"])
            return {"ranked_documents": sorted(asked["documents"], key=lambda d: -len(wanted & _words(d)))}
        if task == "generate":
            wanted, parts = _words(asked["query"]), [s for s in re.split(r"(?<=[.!?])\s+", asked["context"]) if s]
            best = max(parts, key=lambda s: len(wanted & _words(s)), default="")
            return {"answer": best, "reference": best, "rationale": "most words shared with the query"}
        if task == "context":
            return {"context": asked["document"][:100]}
        of = lambda a, b: len(_words(a) & _words(b)) / len(_words(a)) if _words(a) else 0.0
        context, truth = " ".join(asked["contexts"]), asked["ground_truth"] or ""
        return {"faithfulness": of(asked["answer"], context), "answer_accuracy": of(truth, asked["answer"]), "context_precision": of(context, truth), "context_recall": of(truth, context)}


def ask_rows(df: DataFrame, keep: list[str], need: list[str], one: Callable[[dict], dict], schema: str, fallback: Callable[[dict], dict], tries: int = 5, delay: float = 1.0, concurrent: int = CONCURRENT) -> DataFrame:
    """The ``keep`` columns of df and what ``one`` makes of each row, with status and error."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = [*keep, *[c for c in need if c not in keep]]
    out = [*keep, *[x.split()[0] for x in schema.split(", ")], "status", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(row: dict) -> dict:
            try:
                return {**{k: row[k] for k in keep}, **with_retry(lambda: one(row), tries, delay), "status": "success", "error": None}
            except Exception as problem:  # the row's failure is its result
                return {**{k: row[k] for k in keep}, **fallback(row), "status": "error", "error": str(problem)[:80]}

        with ThreadPoolExecutor(concurrent) as pool:
            for frame in frames:
                yield pd.DataFrame(list(pool.map(made, frame.to_dict("records"))), columns=out)

    return df.select(*columns).mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keep], schema, "status string, error string"]))


def _prompted(prompt: str | None) -> tuple[list[str], Callable[[dict], str]]:
    """A step's prompt: one for all rows, or for None each row's own, in column ``prompt``."""
    return (["prompt"], lambda row: row["prompt"]) if prompt is None else ([], lambda row: prompt)


def plan(queries: DataFrame, client: Client, prompt: str | None = PROMPTS["plan"], **retry) -> DataFrame:
    """query_id, text, mode, queries: one query or several; the query itself on failure."""
    need, of = _prompted(prompt)

    def one(row):
        found = client.ask("plan", of(row), json.dumps({"query": row["text"]}))
        asked = found["query"]
        return {"mode": found["mode"], "queries": [asked] if isinstance(asked, str) else list(asked)}

    return ask_rows(queries, ["query_id", "text"], need, one, "mode string, queries array<string>", lambda r: {"mode": "reformulation", "queries": [r["text"]]}, **retry)


def rerank(lists: DataFrame, client: Client, prompt: str | None = PROMPTS["rerank"], k: int = 10, **retry) -> DataFrame:
    """query_id, text, doc_ids, documents, scores of lists (query_id, text, doc_ids, documents): the k first after ranking.

    Of equal texts the nth that the model returns is the nth listed; a text that was not listed, or not as
    often, keeps its place and has a null id. On failure the order stays.
    """
    need, of = _prompted(prompt)

    def one(row):
        docs, ids = list(row["documents"]), list(row["doc_ids"])
        if not docs:
            return {"doc_ids_ranked": [], "ranked": [], "scores": []}
        filled = of(row).replace("{query}", row["text"]).replace("{num_documents}", str(len(docs)))
        ranked = client.ask("rerank", filled, json.dumps({"query": row["text"], "documents": docs}))["ranked_documents"]
        at: dict = {}
        for i, d in enumerate(docs):
            at.setdefault(" ".join(d.split()), []).append(i)
        places = [(at[key].pop(0) if at.get(key := " ".join(d.split())) else None, d) for d in ranked]
        return {"doc_ids_ranked": [None if i is None else ids[i] for i, _ in places][:k], "ranked": [d if i is None else docs[i] for i, d in places][:k], "scores": [1 - i / len(places) for i in range(len(places))][:k]}

    def same(row):
        return {"doc_ids_ranked": list(row["doc_ids"])[:k], "ranked": list(row["documents"])[:k], "scores": [1 / (i + 1) for i in range(len(row["documents"]))][:k]}

    kind = lists.schema["doc_ids"].dataType.simpleString()
    got = ask_rows(lists, ["query_id", "text"], ["doc_ids", "documents", *need], one, f"doc_ids_ranked {kind}, ranked array<string>, scores array<double>", same, **retry)
    return got.withColumnsRenamed({"doc_ids_ranked": "doc_ids", "ranked": "documents"})


def generate(contexts: DataFrame, client: Client, prompt: str | None = PROMPTS["generate"], **retry) -> DataFrame:
    """query_id, text, documents with answer, reference, rationale; empty ones on failure."""
    need, of = _prompted(prompt)

    def one(row):
        context = "\n\n".join(row["documents"])
        filled = of(row).replace("{context}", context).replace("{query}", row["text"])
        found = client.ask("generate", filled, json.dumps({"query": row["text"], "context": context}))
        return {x: found[x] for x in ("answer", "reference", "rationale")}

    return ask_rows(contexts, ["query_id", "text", "documents"], need, one, "answer string, reference string, rationale string", lambda r: {"answer": "", "reference": "", "rationale": ""}, **retry)


def contextualize(chunks: DataFrame, docs: DataFrame, client: Client, prompt: str = PROMPTS["context"], **retry) -> DataFrame:
    """chunk_id, doc_id, chunk_index, chunk, context, contextualized, has_context, status; the chunk alone where a call fails."""

    def one(row):
        filled = prompt.replace("{document}", row["document"]).replace("{chunk}", row["chunk"])
        return {"context": client.ask("context", filled, json.dumps({"document": row["document"], "chunk": row["chunk"]}))["context"]}

    joined = chunks.join(docs.select("doc_id", F.col("text").alias("document")), "doc_id")
    got = ask_rows(joined, ["chunk_id", "doc_id", "chunk_index", "chunk"], ["document"], one, "context string", lambda r: {"context": ""}, **retry)
    return got.select("chunk_id", "doc_id", "chunk_index", "chunk", "context", T.with_context(F.col("context"), F.col("chunk")).alias("contextualized"), (F.coalesce("context", F.lit("")) != "").alias("has_context"), "status")


def embed(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], size: int, id_col: str = "chunk_id", text_col: str = "chunk", batch: int = 512) -> DataFrame:
    """id, embedding, status: blank texts (blank), and batches that fail after the retries (error), have a zero vector."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text_col].tolist()
            made = [[0.0] * size for _ in texts]
            full = [i for i, t in enumerate(texts) if t and t.strip()]
            status = ["blank"] * len(texts)
            for i in full:
                status[i] = "success"
            for at in range(0, len(full), batch):
                part = full[at : at + batch]
                try:
                    for i, v in zip(part, with_retry(lambda part=part: encode([texts[i] for i in part])), strict=True):
                        made[i] = [float(x) for x in v]
                except Exception:  # the zero vectors stand
                    for i in part:
                        made[i], status[i] = [0.0] * size, "error"
            yield pd.DataFrame({id_col: frame[id_col], "embedding": made, "status": status})

    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<double>, status string")


class Metric(NamedTuple):
    """What a judged metric needs of an answer; without it the metric is 0 and nobody is asked."""

    name: str
    contexts: bool
    truth: bool


#: The judged metrics. A caller may judge by others: any client that answers {name: value} will do.
METRICS = (Metric("faithfulness", True, False), Metric("answer_accuracy", False, True), Metric("context_precision", True, True), Metric("context_recall", True, True))


def judge_each(answers: DataFrame, client: Client, prompt: str = PROMPTS["judge"], metrics: tuple[Metric, ...] = METRICS, **retry) -> DataFrame:
    """query_id, metric, value, status, error: one row, and one call with its own retries, for each answer and metric that is due.

    answers are (query_id, text, documents, answer, ground_truth), a query_id once. A call that fails has value 0.
    """
    contexts = F.filter(F.coalesce("documents", F.array().cast("array<string>")), lambda c: c.isNotNull() & (F.trim(c) != ""))
    truth = F.trim(F.coalesce("ground_truth", F.lit("")))
    due = [F.when((F.size(contexts) > 0 if m.contexts else F.lit(True)) & (truth != "" if m.truth else F.lit(True)), m.name) for m in metrics]
    rows = answers.select("query_id", "text", contexts.alias("contexts"), "answer", F.nullif(truth, F.lit("")).alias("truth"), F.explode(F.array_compact(F.array(*due))).alias("metric"))

    def one(row):
        asked = {"query": row["text"], "answer": row["answer"] or "", "contexts": list(row["contexts"]), "ground_truth": row["truth"], "metric": row["metric"]}
        return {"value": float(client.ask("judge", prompt, json.dumps(asked))[row["metric"]])}

    return ask_rows(rows, ["query_id", "metric"], ["text", "contexts", "answer", "truth"], one, "value double", lambda r: {"value": 0.0}, **retry)


def judge(answers: DataFrame, client: Client, prompt: str = PROMPTS["judge"], metrics: tuple[Metric, ...] = METRICS, **retry) -> DataFrame:
    """query_id, text, documents, answer, a column for each metric, status, error, failed (the names of the metrics whose call failed).

    Metrics are judged one by one: a failure costs that metric, which is 0, and no other. status is
    success, partial, or error where every call failed; error is a failed call's message.
    """
    each = judge_each(answers, client, prompt, metrics, **retry)
    bad = F.col("status") == "error"
    wide = each.groupBy(F.col("query_id").alias("q")).agg(
        *[F.max(F.when(F.col("metric") == m.name, F.col("value"))).alias(m.name) for m in metrics],
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(bad, F.col("metric")))).alias("failed"), F.min(F.when(bad, F.col("error"))).alias("error"),
    )
    n_bad = F.coalesce(F.size("failed"), F.lit(0))
    status = F.when(n_bad == 0, "success").when(n_bad < F.col("n"), "partial").otherwise("error")
    joined = answers.select("query_id", "text", "documents", "answer").join(wide, F.col("query_id") == F.col("q"), "left")
    return joined.select("query_id", "text", "documents", "answer", *[F.coalesce(m.name, F.lit(0.0)).alias(m.name) for m in metrics], F.when(F.col("n").isNull(), "success").otherwise(status).alias("status"), "error", F.coalesce("failed", F.array().cast("array<string>")).alias("failed"))
