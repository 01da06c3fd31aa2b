import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import bundles, feedback
from quarry.operators import evaluation as E
from quarry.operators import search as S
from quarry.plans import experiment as X
from quarry.plans import models, rag

RETRY = {"tries": 1, "delay": 0.0}
TEXTS = ["Cats sleep all day. They eat fish.", "Dogs run in the park. They bark.", "Fish swim in the sea.", "Birds sing at dawn.", "Horses run fast on grass."]


class Prompted(models.RuleClient):
    """Reranks well only if the prompt says so."""

    def ask(self, task, prompt, text):
        found = super().ask(task, prompt, text)
        if task == "rerank" and "best" not in prompt:
            found = {"ranked_documents": found["ranked_documents"][::-1]}
        return found


class Broken(models.RuleClient):
    def ask(self, task, prompt, text):
        if task == "plan" and "zebra" in text:
            raise RuntimeError("no plan")
        return super().ask(task, prompt, text)


def corpus(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS, 1)], "doc_id long, text string")
    qrels = spark.createDataFrame([(i, 1 + i % 5) for i in range(20)], "query_id long, doc_id long")
    truths = spark.createDataFrame([(i, TEXTS[i % 5]) for i in range(20)], "query_id long, ground_truth string")
    return X.Corpus.build(docs, qrels, truths)


def queries(spark):
    words = ["cats eat fish", "dogs run in the park", "fish swim in the sea", "birds sing", "horses run fast; on grass"]
    return spark.createDataFrame([(i, f"what about {words[i % 5]}") for i in range(20)], "query_id long, text string")


def test_staged_experiment_and_resume(spark, tmp_path):
    config = X.Config("e", f"file://{tmp_path}", n_queries=10, budget=20, retrieval_k=4, rerank_k=2, retry=RETRY)
    calls = []

    def propose(prompt, records):
        calls.append(records.count())
        assert set(records.schema["record"].dataType.names) == {"Inputs", "Generated Outputs", "Analysis", "Feedback", "Score"}
        return prompt + " best"

    state = X.run(spark, config, queries(spark), corpus(spark), Prompted(), propose)
    assert sorted(len(v) for v in state["ids"].values()) == [2, 2, 6]
    assert [r["module"] for r in state["modules"]] == list(X.MODULES) and state["prompts"]["reranker"].endswith("best") and calls
    by_name = {r["config"]: r for r in state["ablation"]}
    assert list(by_name) == ["baseline", "M1_only", "M1+M2", "M1+M2+M3"] and by_name["baseline"]["gain"] == 0 and by_name["M1+M2"]["gain"] >= 0
    reranker = state["modules"][1]
    assert reranker["best"] > reranker["baseline"] and not reranker["reverted"] and reranker["accepted"] >= 1
    n = len(calls)
    again = X.run(spark, config, queries(spark), corpus(spark), Prompted(), propose, resume_from=4)
    assert len(calls) == n and again["prompts"] == state["prompts"] and [r["score"] for r in again["ablation"]] == pytest.approx([r["score"] for r in state["ablation"]])
    found = json.loads(spark.read.text(f"{config.folder}/summary.json", wholetext=True).first().value.rstrip("\x00"))
    assert found["experiment"] == config.id and len(found["modules"]) == 3
    assert X.load_prompts(spark, f"{config.folder}/prompts", "best") == state["prompts"]
    assert spark.read.option("header", True).csv(f"{config.folder}/metrics/ablation_results.csv").count() == 4
    assert spark.read.json(f"{config.folder}/per_example").select("config").distinct().count() == 4


def test_no_gain_keeps_the_seed(spark):
    config = X.Config(budget=18, retrieval_k=3, retry=RETRY)
    of = X.adapter("query_planner", corpus(spark), models.RuleClient(), config, X.default_prompts())
    rows = queries(spark)
    record = X.optimise_module(of, rows.limit(4), rows.limit(2), lambda prompt, records: prompt + "!", 18)
    assert record["best_prompt"] == record["seed_prompt"] and record["improvement"] == 0 and record["p_value"] == 1 and record["low_budget"] and len(record["iterations"]) == 3


def test_failed_rows_keep_their_place(spark):
    asked = queries(spark).limit(3).unionByName(spark.createDataFrame([(99, "zebra")], "query_id long, text string"))
    config = X.Config(retrieval_k=3, rerank_k=2, retry=RETRY)
    found = {r.query_id: r for r in X.contexts(asked, corpus(spark), Broken(), X.default_prompts(), config).collect()}
    assert len(found) == 4 and found[99].status == "error" and found[99].error == "no plan" and found[99].documents == []
    of = X.adapter("query_planner", corpus(spark), Broken(), config, X.default_prompts(), failure_score=-1.0)
    batch = of.evaluate(asked, {})
    scores = {r.query_id: (r.score, r.success) for r in batch.collect()}
    assert scores[99] == (-1.0, False) and all(ok for q, (_, ok) in scores.items() if q != 99)
    assert of.reflective(batch, ["generator"]) is None and of.reflective(batch, ["query_planner"]).count() == 3
    s = bundles.batch_summary(batch).first()
    assert (s.n, s.n_errors, s.success_rate) == (4, 1, 0.75)


def test_settings(spark, tmp_path):
    config, a = X.options(["--n_queries", "7", "--data_path", "x", "--model", "gpt-4o"])
    assert config.n_queries == 7 and a.data_path == "x" and X.Config.from_json(config.to_json()) == config
    assert config.id != X.Config().id and X.Config().id == X.Config(output="elsewhere").id
    for wrong in (lambda: X.Config(model="other"), lambda: X.with_prompt({}, "retriever", ""), lambda: X.adapter("query_planner", None, None, None, {}, primary="map")):
        with pytest.raises(ValueError):
            wrong()
    assert X.dimension("text-embedding-3-large") == 3072 and X.dimension("?") == 1536
    assert [r.query_id for r in X.first_queries(queries(spark), 3).collect()] == [0, 1, 2]


def test_command_line(spark, tmp_path):
    (tmp_path / "documents.json").write_text(json.dumps([{"doc_id": f"d{i}", "text": t} for i, t in enumerate(TEXTS)]))
    (tmp_path / "queries.json").write_text(json.dumps([{"query_id": i, "query": f"about {t.split()[0]} {t.split()[1]}", "ground_truth": t, "reference_doc_ids": [f"d{i}"]} for i, t in enumerate(TEXTS)]))
    state = X.main(["--data_path", f"file://{tmp_path}", "--output_dir", f"file://{tmp_path}/out", "--budget", "3", "--retrieval_k", "3"])
    assert state["baseline"]["n_examples"] == 1 and len(state["ablation"]) == 4


def test_hybrid_takes_both_lists(spark):
    c = corpus(spark)
    planned = spark.createDataFrame([(1, "q", ["cats eat", "dogs bark"]), (2, "none", ["zebra"])], "query_id long, text string, queries array<string>")

    def dense(asked, k):
        return asked.crossJoin(spark.createDataFrame([(4, 0.9, 1), (5, 0.8, 2)], "doc_id long, score double, rank int")).drop("text")

    got = {r.query_id: list(r.doc_ids) for r in rag.retrieve(planned, c.docs, 3, c.index, dense).collect()}
    assert got[2] == [4, 5] and 4 in got[1] and set(got[1]) & {1, 2} and len(got[1]) == 3
    alone = {r.query_id: list(r.doc_ids) for r in rag.retrieve(planned, c.docs, 3, c.index).collect()}
    assert set(alone[1]) == {1, 2, 3} or set(alone[1]) == {1, 2} and alone[2] == []


def test_dense_of_any_ids(spark):
    v = spark.createDataFrame([(f"c{i:02d}", [1.0, float(i)]) for i in range(50)], "doc_id string, embedding array<double>")
    q = spark.createDataFrame([((1, "a"), [1.0, 0.0]), ((2, "b"), [0.0, 1.0])], "query_id struct<x:long,y:string>, embedding array<double>")
    got = {}
    for r in S.dense(v, q, 3, block=1).collect():
        got.setdefault(r.query_id.x, []).append((r["rank"], r.doc_id))
    assert [d for _, d in sorted(got[1])] == ["c00", "c01", "c02"] and [d for _, d in sorted(got[2])] == ["c49", "c48", "c47"]


def test_sweep_form_with_negative_scores(spark):
    """Terms that most documents have score below zero; documents without any come before them."""
    docs = spark.createDataFrame([(i, "common words" if i < 12 else "nothing here") for i in range(15)], "doc_id long, text string")
    got = S.bm25(docs, spark.createDataFrame([(1, "common")], "query_id long, text string"), 3, positive_only=False).orderBy("rank").collect()
    n, df = 15, {"common": 12, "words": 12, "nothing": 3, "here": 3}
    import math

    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / 4
    assert (mean < 0) == (got[0].doc_id == 12) and len(got) == 3


def test_split_is_whole_and_seeded(spark):
    asked = spark.range(103).withColumnRenamed("id", "query_id")
    a, b = ({r.query_id: r.split for r in E.split(asked.repartition(n)).collect()} for n in (1, 7))
    assert a == b and sorted(a) == list(range(103)) and {s: list(a.values()).count(s) for s in ("train", "validation", "test")} == {"train": 61, "validation": 20, "test": 22}
    assert E.split(asked.limit(0)).count() == 0 and a != {r.query_id: r.split for r in E.split(asked, 7).collect()}


def test_feedback_rules(spark):
    c = lambda *xs: [F.lit(float(x)) for x in xs]
    p = lambda score, pr, rc, hits, due, mode, n, div, cov: feedback.planner(*c(score, pr, rc, hits, due), F.lit(mode), F.lit(n), *c(div, cov))
    row = spark.range(1).select(
        p(0.5, 0.5, 0.5, 2, 4, "decomposition", 2, 0.6, 0.8).alias("a"), p(0.3, 0.5, 0.3, 2, 6, "reformulation", 1, 0.6, 0.8).alias("b"), p(0.1, 0.5, 0.05, 0, 6, "reformulation", 1, 0.6, 0.8).alias("c"),
        feedback.reranker(*c(0.3, 0.3, 0.45, 0.2, 0.66, 0.39, 1)).alias("d"), feedback.reranker(*c(0.1, 0.1, 0.1, 0.1, 0.71, 0.2, 0.5)).alias("e"),
        feedback.generator(*c(0.7, 0.8, 0.6, 0.7, 0.8, 0.1), F.lit(True)).alias("f"), feedback.generator(*c(0.4, 0.2, 0.6, 0.4, 0.9, 0.35), F.lit(True)).alias("g"), feedback.generator(*c(0.1, 0.1, 0.1, 0.1, 0.1, 0.5), F.lit(False)).alias("h"),
        feedback.plain(F.lit(0.7)).alias("i"), feedback.advice(F.lit("off topic")).alias("j"),
    ).first()
    assert "Splitting" in row.a and "differ" in row.a and "kept" in row.a and "Split the question" in row.b and "Next to nothing" in row.c and "several queries" in row.c
    assert "too low" in row.d and "poor" in row.d and "Long documents" in row.d and "few of" in row.d
    assert all(x in row.e for x in ("No relevant", "first five", "hardly changed", "Length decides", "play no part"))
    assert "rests on" in row.f and "plain" in row.f and "only what" in row.g and "Use more" in row.g and "Hedge less" in row.g
    assert all(x in row.h for x in ("isn't in", "doesn't answer", "hardly used", "taken up", "hedges", "nothing specific"))
    assert row.i.startswith("Works") and "subject" in row.j


def test_chunkers_are_linear(spark):
    import time

    from quarry.functions import chunking

    text = "Some words here. And more! " * 100_000
    began = time.time()
    assert "".join(x[:-50] for x in chunking.cuts(text, 600, 50, "index")[:-1]).startswith("Some words") and time.time() - began < 5
    with pytest.raises(KeyError):
        rag.models.PROMPTS["none"]
    assert bundles.evaluate("unknown", spark.range(2).withColumnRenamed("id", "query_id")).columns == ["query_id"]


def test_retry_only_what_may_pass():
    calls = []

    def bug():
        calls.append(1)
        raise KeyError("x")

    with pytest.raises(KeyError):
        models.with_retry(bug, sleep=lambda s: None)
    assert len(calls) == 1 and models.retryable(TimeoutError()) and models.retryable(Exception("Rate limit reached"))


class Logged(Prompted):
    """Writes every call down, with its prompt."""

    def __init__(self, path):
        self.path = str(path)

    def ask(self, task, prompt, text):
        with open(self.path, "a") as f:
            f.write(json.dumps([task, prompt, text]) + "\n")
        return super().ask(task, prompt, text)


def test_no_step_is_asked_twice(spark, tmp_path):
    config = X.Config(retrieval_k=4, rerank_k=2, retry=RETRY)
    seed = X.default_prompts()
    best = {m: p + " best" for m, p in seed.items()}
    sets = X.ablation_configs(seed, best)
    test = queries(spark).where("query_id < 5")
    table, scores = X.ablate(sets, test, corpus(spark), Logged(tmp_path / "calls"), config)
    calls = [tuple(json.loads(x)) for x in (tmp_path / "calls").read_text().splitlines()]
    by_task = {t: [c for c in calls if c[0] == t] for t in ("plan", "rerank", "generate", "judge")}
    assert {t: len(c) for t, c in by_task.items()} == {"plan": 10, "rerank": 15, "generate": 20, "judge": 80}
    assert len({c[1:] for c in by_task["plan"]}) == 10
    # The same figures as one configuration after the other.
    for name, prompts in sets.items():
        alone = X.evaluate_split(X.contexts(test, corpus(spark), Prompted(), prompts, config), corpus(spark), Prompted(), prompts, config)
        want = {r.query_id: r.overall_quality for r in alone.collect()}
        assert {r.query_id: r.score for r in scores.where(F.col("config") == name).collect()} == pytest.approx(want)
    rows = {r.config: r for r in table.collect()}
    assert list(rows) == list(sets) and rows["baseline"].gain == 0 and rows["baseline"].p_value == 1 and rows["M1+M2"].score == pytest.approx(rows["M1+M2+M3"].score)


def test_ablation_of_nothing(spark):
    config = X.Config(retrieval_k=4, rerank_k=2, retry=RETRY)
    table, scores = X.ablate({"a": X.default_prompts(), "b": X.default_prompts()}, queries(spark).limit(0), corpus(spark), models.RuleClient(), config)
    assert [(r.config, r.score, r.p_value) for r in table.collect()] == [("a", 0.0, 1.0), ("b", 0.0, 1.0)] and scores.count() == 0
