import random

import pytest
from pyspark.sql import functions as F

from quarry.plans import experiment as X
from quarry.plans import pareto


def _matrix(spark, rows):
    return spark.createDataFrame([(c, q, float(s)) for c, qs in enumerate(rows) for q, s in enumerate(qs)], "candidate int, query_id long, score double")


def _by_hand(rows):
    """Frontier sets by query, then what no other candidate covers."""
    best = [max(round(r[q], 9) for r in rows) for q in range(len(rows[0]))]
    sets = {c: {q for q, s in enumerate(r) if round(s, 9) == best[q]} for c, r in enumerate(rows)}
    means = {c: round(sum(r) / len(r), 9) for c, r in enumerate(rows)}
    covers = lambda b, a: b != a and sets[a] <= sets[b] and (len(sets[b]) > len(sets[a]) or (means[b], -b) > (means[a], -a))
    return sets, {c: (len(s), means[c]) for c, s in sets.items() if s and not any(covers(b, c) for b in sets)}


@pytest.mark.parametrize("seed", range(4))
def test_frontier_and_parents(spark, seed):
    rng = random.Random(seed)
    rows = [[rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(6)] for _ in range(8)]
    sets, kept = _by_hand(rows)
    got = {(r.candidate, r.query_id) for r in pareto.frontier(_matrix(spark, rows)).collect()}
    assert got == {(c, q) for c, qs in sets.items() for q in qs}
    assert {r.candidate: (r.wins, round(r["mean"], 6)) for r in pareto.parents(_matrix(spark, rows)).collect()} == {c: (n, round(m, 6)) for c, (n, m) in kept.items()}


def test_equal_candidates_leave_the_first(spark):
    assert [r.candidate for r in pareto.parents(_matrix(spark, [[1, 0], [1, 0], [1, 0]])).collect()] == [0]
    assert pareto.parents(_matrix(spark, [[1]]).limit(0)).collect() == []


def test_minibatches_come_round(spark):
    rows = spark.range(12).withColumnRenamed("id", "query_id")
    drawn = [tuple(sorted(r.query_id for r in pareto.minibatch(rows, 3, 1, step).collect())) for step in range(12)]
    assert len(set(drawn)) > 6 and len({q for b in drawn for q in b}) >= 10 and drawn[0] == tuple(sorted(r.query_id for r in pareto.minibatch(rows.repartition(5), 3, 1, 0).collect()))


class Skills:
    """A prompt is a set of letters; a query needs letters. Letters of one prompt above two spoil each other, but for the full set."""

    module = "generator"

    def __init__(self, spark):
        self.spark, self.calls = spark, 0

    def worth(self, prompt: str, query: int) -> float:
        known = set(prompt) - {"s"}
        if known >= {"a", "b", "c"}:
            return 1.0
        # "a" helps even queries a lot and spoils odd ones, "b" helps odd ones less: its mean is below that of "a".
        return {"": 0.1, "a": 0.6 if query % 2 == 0 else 0.0, "b": 0.0 if query % 2 == 0 else 0.5, "ab": 0.05}.get("".join(sorted(known)), 0.0)

    def evaluate(self, batch, prompts):
        rows = [r.query_id for r in batch.collect()]
        self.calls += len(rows)
        return self.spark.createDataFrame([(q, self.worth(prompts[self.module], q), True) for q in rows], "query_id long, score double, success boolean")

    def reflective(self, scored, components):
        return scored.select("query_id", F.lit("x").alias("record"))


def _proposer():
    """From "a" only spoiled prompts come; the whole set is found from "b"."""
    turns = {"s": iter(["sa", "sb"] * 50)}

    def propose(prompt, records):
        if prompt == "sb":
            return "sbac"
        return next(turns["s"]) if prompt == "s" else prompt + "x"

    return propose


def test_the_frontier_finds_what_the_best_mean_does_not(spark):
    train = spark.range(0, 8).withColumnRenamed("id", "query_id")
    validation = spark.range(100, 104).withColumnRenamed("id", "query_id")
    of = Skills(spark)
    pool = pareto.search(of, "s", train, validation, _proposer(), 160, size=4)
    assert pool.prompts[pool.best] == "sbac" and pool.means[pool.best] == 1.0
    assert pool.spent <= 160 and of.calls == pool.spent and pool.came_from[pool.prompts.index("sbac")] == pool.prompts.index("sb")
    assert {s["iteration"] for s in pool.steps} == set(range(1, len(pool.steps) + 1)) and sum(s["accepted"] for s in pool.steps) == len(pool.prompts) - 1
    assert {(r.candidate, r.n) for r in pool.matrix.groupBy("candidate").agg(F.count("*").alias("n")).collect()} == {(c, 4) for c in range(len(pool.prompts))}
    # The climber takes "sa" for its mean and never sees anything but its children.
    greedy = Skills(spark)
    greedy.prompts = {"generator": "s"}
    best, tried = X._greedy(greedy, train, 8, 4, _proposer(), 160)
    assert best == "sa" and not any(t["prompt"] == "sbac" for t in tried)


def test_perfect_rows_teach_nothing_and_small_budgets_stop(spark):
    rows = spark.range(4).withColumnRenamed("id", "query_id")
    of = Skills(spark)

    def never(prompt, records):
        raise AssertionError("proposed")

    pool = pareto.search(of, "sabc", rows, rows, never, 30, size=2)
    assert pool.prompts == ["sabc"] and pool.steps and all(s["prompt"] is None and not s["accepted"] for s in pool.steps)
    assert pareto.search(of, "s", rows, rows, never, 3, size=2).steps == []
    assert pareto.search(of, "s", rows.limit(0), rows, never, 30, size=2).steps == []


def test_unknown_search():
    with pytest.raises(ValueError):
        X.optimise_module(None, None, None, None, 1, search="other")
