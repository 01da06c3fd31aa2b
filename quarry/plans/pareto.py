"""Prompt search over a pool of candidates: a score matrix (candidate, query_id, score), its frontier by query, parents drawn from it.

A candidate that is best for some queries stays a parent even where its mean is not the best, so a search
doesn't stick where a single best prompt would. The matrix is a table; what the driver holds is one row
a candidate, and the budget bounds how many there are.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import storage

#: Rows of a minibatch, and the score from which a row teaches nothing.
MINIBATCH, PERFECT = 3, 1.0


def frontier(matrix: DataFrame, digits: int = 9) -> DataFrame:
    """candidate, query_id, score of every candidate that has a query's best score (equal to so many digits)."""
    best = F.max(F.round("score", digits)).over(Window.partitionBy("query_id"))
    return matrix.withColumn("__best", best).where(F.round("score", digits) == F.col("__best")).drop("__best")


def parents(matrix: DataFrame, digits: int = 9) -> DataFrame:
    """candidate, wins, mean of the frontier's candidates that no other covers.

    b covers a if it is best wherever a is and, where both are best for the same queries, has the higher mean
    (of equal means the smaller candidate). wins is for how many queries a candidate is best. Pairs are
    of candidates that are best for one query, so of at most as many as there are candidates.
    """
    front = frontier(matrix, digits)
    wins = front.groupBy("candidate").agg(F.count("*").alias("wins"))
    means = matrix.groupBy("candidate").agg(F.round(F.avg("score"), digits).alias("mean"))
    known = wins.join(means, "candidate")
    a, b = front.select("query_id", F.col("candidate").alias("a")), front.select("query_id", F.col("candidate").alias("b"))
    both = a.join(b, "query_id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    of = lambda x: known.select(F.col("candidate").alias(x), F.col("wins").alias(f"{x}_wins"), F.col("mean").alias(f"{x}_mean"))
    judged = both.join(of("a"), "a").join(of("b"), "b")
    better = (F.col("b_wins") > F.col("a_wins")) | (F.col("b_mean") > F.col("a_mean")) | ((F.col("b_mean") == F.col("a_mean")) & (F.col("b") < F.col("a")))
    covered = judged.where((F.col("shared") == F.col("a_wins")) & better).select(F.col("a").alias("candidate")).distinct()
    return known.join(covered, "candidate", "left_anti")


def minibatch(queries: DataFrame, size: int, seed: int, step: int) -> DataFrame:
    """size queries of the step, by a hash: all come round, none by its place in the table."""
    return queries.orderBy(F.xxhash64("query_id", F.lit(seed), F.lit(step)), "query_id").limit(size)


class Evaluator(Protocol):
    module: str

    def evaluate(self, batch: DataFrame, prompts: dict[str, str]) -> DataFrame: ...  # query_id, score, success
    def reflective(self, scored: DataFrame, components: list[str]) -> DataFrame | None: ...


@dataclass
class Pool:
    """The candidates of a search in the order in which they came: prompt, parent (None for the seed), mean; and their matrix."""

    prompts: list[str] = field(default_factory=list)
    came_from: list[int | None] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    parts: list[DataFrame] = field(default_factory=list)
    spent: int = 0
    steps: list[dict] = field(default_factory=list)

    @property
    def matrix(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    @property
    def best(self) -> int:
        """The candidate of the highest mean; of equal ones the first."""
        return max(range(len(self.means)), key=lambda i: (round(self.means[i], 9), -i))

    def add(self, prompt: str, parent: int | None, scores: DataFrame) -> int:
        number = len(self.prompts)
        part = storage.write(scores.select(F.lit(number).alias("candidate"), "query_id", F.col("score").cast("double").alias("score")), "scores")
        self.prompts.append(prompt)
        self.came_from.append(parent)
        self.means.append(mean(part))
        self.parts.append(part)
        return number


def mean(scores: DataFrame) -> float:
    return float(scores.agg(F.avg("score").alias("m")).first().m or 0.0)


def search(of: Evaluator, seed: str, train: DataFrame, validation: DataFrame, propose: Callable[[str, DataFrame], str], budget: int, size: int = MINIBATCH, perfect: float = PERFECT, random_seed: int = 42) -> Pool:
    """The pool after ``budget`` evaluations of a row.

    Each step draws a parent by its wins on the validation rows, runs it on a minibatch of the training
    rows, and proposes a candidate from what went wrong there. One that isn't strictly better on
    the same minibatch is dropped; one that is joins the pool with its scores on all validation rows. Where all rows
    of a minibatch are perfect nothing is proposed. A step begins only if the budget holds all that it may cost.
    """
    rng, pool = random.Random(random_seed), Pool()
    train, n_train, n_all = storage.write(train, "train"), train.count(), validation.count()
    size = min(size, n_train)
    pool.add(seed, None, of.evaluate(validation, {of.module: seed}))
    pool.spent = n_all
    while size and pool.spent + 2 * size + n_all <= budget:
        step = len(pool.steps)
        drawn = sorted((r.candidate, r.wins) for r in parents(pool.matrix).collect())  # one row a candidate
        parent = rng.choices([c for c, _ in drawn], [w for _, w in drawn])[0] if drawn else 0
        batch = storage.write(minibatch(train, size, random_seed, step), "minibatch")
        before = of.evaluate(batch, {of.module: pool.prompts[parent]})
        pool.spent += size
        told = {"iteration": step + 1, "parent": parent, "prompt": None, "score": None, "accepted": False}
        pool.steps.append(told)
        least, was = before.agg(F.min("score"), F.sum("score")).first()
        if least >= perfect:
            continue
        prompt = propose(pool.prompts[parent], of.reflective(before, [of.module]))
        after = of.evaluate(batch, {of.module: prompt})
        pool.spent += size
        now = after.agg(F.sum("score")).first()[0]
        told.update(prompt=prompt, score=now / size, accepted=round(now, 9) > round(was, 9))
        if told["accepted"]:
            pool.add(prompt, parent, of.evaluate(validation, {of.module: prompt}))
            pool.spent += n_all
    return pool
