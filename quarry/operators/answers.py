"""Answer-quality measures without a model: overlaps, hedging, addressing, list bias."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that hedge an answer.
HEDGES = "might could may possibly perhaps probably likely unlikely seems appears suggest suggests indicate indicates potential potentially uncertain unclear approximately roughly about around".split()


def word_set(c: Column, longer_than: int = 0) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > longer_than))


def share(a: Column, b: Column) -> Column:
    """card(a and b) / card(a), 0 where a is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def hedging(c: Column) -> Column:
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    found = F.size(F.filter(words, lambda w: w.isin(HEDGES)))
    return F.when(F.size(words) > 0, F.least(F.lit(1.0), 10.0 * found / F.size(words))).otherwise(0.0)


def addressing(query: Column, answer: Column) -> Column:
    """Share of the query's longer words that occur anywhere in the answer; 1 where it has none."""
    terms = word_set(query, 3)
    low = F.lower(answer)
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms)).otherwise(1.0)


def specific(c: Column) -> Column:
    return c.rlike(r"\d+") | c.rlike(r"\b[A-Z][a-z]+")


def length_bias(docs: Column) -> Column:
    """Mean words of a list's upper half over both halves' means; 0.5 for short or empty lists."""
    count = lambda d: F.size(F.filter(F.split(d, r"\s+"), lambda w: w != "")).cast("double")
    lengths = F.transform(docs, count)
    half = F.floor(F.size(docs) / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    top, bottom = mean(F.slice(lengths, 1, F.greatest(half, F.lit(1)))), mean(F.slice(lengths, F.greatest(half, F.lit(1)) + 1, F.size(docs)))
    return F.when(F.size(docs) < 2, 0.5).when(top + bottom == 0, 0.5).otherwise(top / (top + bottom))
