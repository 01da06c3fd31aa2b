import pytest
from pyspark.sql import functions as F

from quarry.operators import bundles, reranked
from quarry.plans import models, rag

RETRY = {"tries": 2, "delay": 0.0}


class FailsOn(models.RuleClient):
    """No answer for some metrics; writes its calls down."""

    def __init__(self, path, *metrics, message="broken"):
        self.path, self.metrics, self.message = str(path), metrics, message

    def ask(self, task, prompt, text):
        import json

        if task == "judge":
            metric = json.loads(text)["metric"]
            with open(self.path, "a") as f:
                f.write(metric + "\n")
            if metric in self.metrics:
                raise RuntimeError(self.message)
        return super().ask(task, prompt, text)


def _answers(spark):
    rows = [(1, "what eats", ["Cats eat fish.", " "], "Cats eat fish", "cats eat"), (2, "what eats", [], "Cats", "cats"), (3, "q", ["c"], "a", None), (4, "q", None, None, " ")]
    return spark.createDataFrame(rows, "query_id long, text string, documents array<string>, answer string, ground_truth string")


def test_one_failure_costs_one_metric(spark, tmp_path):
    good = {r.query_id: r for r in models.judge(_answers(spark), models.RuleClient(), **RETRY).collect()}
    bad = {r.query_id: r for r in models.judge(_answers(spark), FailsOn(tmp_path / "c", "faithfulness"), **RETRY).collect()}
    assert sorted(good) == sorted(bad) == [1, 2, 3, 4] and all(r.status == "success" and list(r.failed) == [] for r in good.values())
    assert bad[1].status == "partial" and list(bad[1].failed) == ["faithfulness"] and bad[1].error == "broken" and bad[1].faithfulness == 0 < good[1].faithfulness
    assert all(bad[i][m] == good[i][m] for i in good for m in models.JUDGED if m != "faithfulness")
    assert bad[2].status == "success" and bad[3].status == "error" and bad[4].status == "success"  # 3 has one metric, 4 has none


def test_metrics_retry_alone(spark, tmp_path):
    each = models.judge_each(_answers(spark).where("query_id = 1"), FailsOn(tmp_path / "c", "context_recall", message="429"), **RETRY).collect()
    assert {(r.metric, r.status) for r in each} == {("faithfulness", "success"), ("answer_accuracy", "success"), ("context_precision", "success"), ("context_recall", "error")}
    calls = (tmp_path / "c").read_text().split()
    assert {m: calls.count(m) for m in set(calls)} == {"faithfulness": 1, "answer_accuracy": 1, "context_precision": 1, "context_recall": 2}


def test_other_metrics(spark):
    class Polite:
        def ask(self, task, prompt, text):
            return {"politeness": 0.5}

    got = models.judge(_answers(spark), Polite(), metrics=(models.Metric("politeness", False, False),), **RETRY).collect()
    assert [r.politeness for r in got] == [0.5] * 4


def test_overall_quality_with_a_failed_metric(spark, tmp_path):
    answered = _answers(spark).select("query_id", "text", "documents", "answer", F.lit("success").alias("status"))
    truths = _answers(spark).select("query_id", "ground_truth")
    got = {r.query_id: r for r in rag.evaluate(answered, truths, FailsOn(tmp_path / "c", "faithfulness"), **RETRY).collect()}
    assert set(got) == {1, 3} and got[1].faithfulness == 0 and got[1].overall_quality > 0


def _by_hand(before, after):
    at = {}
    for rank, doc, text in before:
        at.setdefault(" ".join(text.split()), []).append((doc, rank))
    out = []
    for rank, text in after:
        left = at.get(" ".join(text.split()))
        out.append((rank, *(left.pop(0) if left else (-1, None))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equal_texts_match_in_order(spark, seed):
    import random

    rng = random.Random(seed)
    lists = {q: ([(i + 1, 100 * q + i, rng.choice(["a", "b", "b  c", "d"])) for i in range(6)], [(i + 1, rng.choice(["a", "b c", " b", "d", "x"])) for i in range(7)]) for q in range(5)}
    before = spark.createDataFrame([(q, *r) for q, (b, _) in lists.items() for r in b], "query_id long, rank int, doc_id long, text string")
    after = spark.createDataFrame([(q, *r) for q, (_, a) in lists.items() for r in a], "query_id long, rank int, text string")
    got = sorted(map(tuple, reranked.match(before, after).collect()), key=str)
    assert got == sorted(((q, *r) for q, (b, a) in lists.items() for r in _by_hand(b, a)), key=str)
    key = lambda t: " ".join(t.split())
    for r in reranked.changed(before, after, 3).collect():
        x, y = [key(t) for _, _, t in lists[r.query_id][0][:3]], [key(t) for _, t in lists[r.query_id][1][:3]]
        assert r.n_changed == sum(a != b for a, b in zip(x, y)) and r.n_left == sum(max(0, x.count(t) - y.count(t)) for t in set(x))


def test_rerank_keeps_the_place_of_unknown_texts(spark):
    class Invents:
        def ask(self, task, prompt, text):
            return {"ranked_documents": ["b", "of nobody", "a", "a", "a"]}

    lists = spark.createDataFrame([(1, "q", [7, 8, 9], ["a", "b", "a"])], "query_id long, text string, doc_ids array<long>, documents array<string>")
    got = models.rerank(lists, Invents(), **RETRY).first()
    assert list(got.doc_ids) == [8, None, 7, 9, None] and list(got.documents) == ["b", "of nobody", "a", "a", "a"]


def test_evaluators_by_kind(spark, monkeypatch):
    monkeypatch.setattr(bundles, "KINDS", dict(bundles.KINDS))
    planned = spark.createDataFrame([(1, "decomposition", ["a", "b"]), (2, "reformulation", ["c"])], "query_id long, mode string, queries array<string>")
    assert {r.query_id: (r.num_queries, r.is_decomposition) for r in bundles.evaluate("query_planner", planned).collect()} == {1: (2, 1.0), 2: (1, 0.0)}

    class Lengths:
        kind = "lengths"

        def evaluate(self, *frames):
            return frames[0].select("query_id", F.size("queries").alias("n"))

    assert bundles.evaluate("lengths", planned).columns == ["query_id"]  # unknown yet
    bundles.register(Lengths())
    assert {r.n for r in bundles.evaluate("lengths", planned).collect()} == {1, 2}
    with pytest.raises(ValueError):
        bundles.register(Lengths())
    with pytest.raises(ValueError):
        bundles.evaluate("retrieval", planned)


class Counts(models.RuleClient):
    """Writes down what it is asked."""

    def __init__(self, path):
        self.path = str(path)

    def ask(self, task, prompt, text):
        with open(self.path, "a") as f:
            f.write(task + "\n")
        return super().ask(task, prompt, text)


def test_every_step_is_asked_once(spark, tmp_path):
    """Plans and answers are kept, however often the search and the judge read them; texts meet their results by broadcast."""
    docs = spark.createDataFrame([(0, "Cats eat fish."), (1, "Dogs run far."), *[(i, f"Words of text{i} alone.") for i in range(2, 9)]], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "what do cats eat?"), (2, "fish; dogs")], "query_id long, text string")
    client = Counts(tmp_path / "c")
    answered = rag.answer(asked, docs, client, **RETRY)
    truths = asked.withColumnRenamed("text", "ground_truth")
    assert rag.evaluate(answered, truths, client, **RETRY).count() == 2
    calls = (tmp_path / "c").read_text().split()
    assert {t: calls.count(t) for t in ("plan", "rerank", "generate")} == {"plan": 2, "rerank": 2, "generate": 2}
