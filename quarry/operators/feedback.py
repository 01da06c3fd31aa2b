"""What a prompt's author is told of one example: its pattern, what to change, and a record to reflect on.

All are columns; thresholds are fixed values, words are ours. No record shows the ground truth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.scoring import TIERS, tier

# The score from which a result without a module's own tiers is good.
GOOD = 0.7

PATTERN_ADVICE = {
    "precise, low coverage": "Ask more widely: what is found is right, but much is missed.",
    "broad, decent coverage": "Ask more narrowly: much of what is found doesn't belong.",
    "off topic": "The search words miss the subject; name it in the documents' own words.",
    "good first hit, poor tail": "The first result is right; let further queries bring the others up.",
    "good ranking, incomplete": "The order is right; add queries for the missing side of the question.",
    "mixed": "No single fault; compare what was found with what was asked.",
}


def advice(pattern: Column) -> Column:
    """Advice on a retrieval pattern (evaluation.pattern)."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in PATTERN_ADVICE.items() for x in kv]), pattern)


def _first(*rules: tuple[Column, str]) -> Column:
    """The words of the first rule that holds, or none."""
    out = None
    for holds, words in rules:
        out = F.when(holds, words) if out is None else out.when(holds, words)
    return out.otherwise("")


def _all(*rules: tuple[Column, str]) -> Column:
    return F.concat_ws(" ", *[F.when(holds, words) for holds, words in rules])


def _said(*parts: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r" {2,}", " "))


def _by_tier(score: Column, module: str, positive: Column, partial: Column, negative: Column) -> Column:
    high, low = TIERS[module]
    return F.when(score >= high, positive).when(score >= low, partial).otherwise(negative)


def planner(score: Column, precision: Column, recall: Column, hits: Column, relevant: Column, mode: Column, n_queries: Column, diversity: Column, coverage: Column) -> Column:
    """Feedback on a query plan."""
    told = F.format_string("%d of %d relevant found (precision %.2f, recall %.2f).", hits.cast("long"), relevant.cast("long"), precision, recall)
    split = (mode == "decomposition") & (n_queries > 1)
    good = _said(F.lit("Works."), told, F.when(split, "Splitting the question helped.").otherwise("One rewritten query sufficed."), _all((diversity > 0.5, "Queries differ well."), (coverage > 0.7, "The question's words are kept.")))
    fix = _first(
        ((mode == "reformulation") & (relevant > 3) & (recall < 0.4), "Split the question: one query can't reach so many documents."),
        ((mode == "decomposition") & (n_queries > 3) & (precision < 0.3), "Fewer, sharper queries: the many bring noise."),
        (diversity < 0.3, "Queries repeat each other; vary their words."),
        (coverage < 0.5, "Keep more of the question's own words."),
    )
    half = _said(F.lit("Half way."), told, fix)
    fault = F.when(recall < 0.1, "Next to nothing relevant was found.").when(precision < 0.1, "Nearly all that was found is off topic.").otherwise("Little of use was found.")
    repair = (
        F.when(n_queries == 1, "Try several queries from different sides.").when(n_queries > 3, "Try fewer queries, each closer to the question.")
        .when(diversity < 0.2, "The queries are nearly the same.").when(coverage < 0.3, "The queries have lost the question's words.").otherwise("Rethink which words the documents would use.")
    )
    return _by_tier(score, "planner", good, half, _said(F.lit("Fails."), told, fault, repair))


def reranker(score: Column, ndcg: Column, mrr: Column, precision_at_5: Column, length_bias: Column, overlap: Column, change: Column) -> Column:
    """Feedback on a ranked list."""
    told = F.format_string("ndcg %.2f, mrr %.2f, precision at 5 %.2f.", ndcg, mrr, precision_at_5)
    good = _said(F.lit("Works."), told, _all((overlap > 0.6, "What meets the question's words comes first."), (change > 2, "The order was truly changed.")))
    half = _said(F.lit("Half way."), told, _all(
        (mrr < 0.5, "The first relevant document stands too low."), (ndcg < 0.8 * mrr, "After the first hit the order is poor."), (length_bias > 0.65, "Long documents come first; judge what they say."),
        (length_bias < 0.35, "Short documents come first; a full answer may be longer."), (overlap < 0.4, "The first documents hold few of the question's words."),
    ))
    bad = _said(F.lit("Fails."), told, _all(
        (mrr < 0.2, "No relevant document is near the top."), (precision_at_5 < 0.2, "The first five are mostly off topic."), (change < 1, "The order hardly changed; rank by relevance, not by place."),
        (length_bias > 0.7, "Length decides the order."), (overlap < 0.3, "The question's words play no part."),
    ))
    return _by_tier(score, "reranker", good, half, bad)


def generator(score: Column, faithfulness: Column, accuracy: Column, usage: Column, addressed: Column, hedging: Column, specific: Column) -> Column:
    """Feedback on an answer."""
    told = F.format_string("faithfulness %.2f, accuracy %.2f.", faithfulness, accuracy)
    good = _said(F.lit("Works."), told, _all((usage > 0.6, "It rests on the context."), (addressed > 0.7, "It answers what was asked."), (hedging < 0.2, "It is plain.")))
    weaker = (
        F.when(faithfulness < accuracy, _said(F.lit("Say only what the context says."), _all((usage < 0.5, "Use more of it."))))
        .when(accuracy < faithfulness, _said(F.lit("It rests on the context but misses the question."), _all((addressed < 0.5, "Take up the question's words."))))
        .otherwise("Both sides need work.")
    )
    half = _said(F.lit("Half way."), told, weaker, _all((hedging > 0.3, "Hedge less.")))
    bad = _said(F.lit("Fails."), told, _all(
        (faithfulness < 0.3, "Most of it isn't in the context."), (accuracy < 0.3, "It doesn't answer the question."), (usage < 0.3, "The context is hardly used."),
        (addressed < 0.3, "The question is hardly taken up."), (hedging > 0.4, "It hedges too much."), (~specific, "It names nothing specific."),
    ))
    return _by_tier(score, "generator", good, half, bad)


def plain(score: Column, threshold: float = GOOD) -> Column:
    """Feedback where only a score is known."""
    return F.when(score >= threshold, F.format_string("Works: score %.3f.", score)).otherwise(F.format_string("Falls short: score %.3f.", score))


def _record(inputs: Column, outputs: Column, analysis: Column, feedback: Column, score: Column) -> Column:
    return F.struct(inputs.alias("Inputs"), outputs.alias("Generated Outputs"), analysis.alias("Analysis"), feedback.alias("Feedback"), F.format_string("%.3f", score).alias("Score"))


def planner_record(query: Column, mode: Column, queries: Column, diversity: Column, coverage: Column, hits: Column, relevant: Column, precision: Column, recall: Column, ndcg: Column, score: Column, told: Column) -> Column:
    """A plan to reflect on: its queries by number, how they differ, and what they found."""
    listed = F.array_join(F.transform(queries, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")
    made = F.concat(F.lit("Mode: "), mode, F.lit("\n"), listed, F.format_string("\n%d queries, diversity %.2f, coverage %.2f", F.size(queries), diversity, coverage))
    found = F.format_string("%d of %d relevant found (precision %.1f %%, recall %.1f %%, ndcg %.2f)", hits.cast("long"), relevant.cast("long"), precision * 100, recall * 100, ndcg)
    return _record(F.concat(F.lit("Question: "), query), made, found, told, score)


def _listed(docs: Column) -> Column:
    """The first five, 150 characters of each, by number."""
    return F.array_join(F.transform(F.slice(docs, 1, 5), lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), T.preview(d, 150))), "\n")


def reranker_record(query: Column, docs: Column, ranked: Column, change: Column, length_bias: Column, overlap: Column, score: Column, told: Column) -> Column:
    """A ranked list to reflect on: five previews before and after."""
    more = F.when(F.size(docs) > 5, F.format_string("\n... and %d more", F.size(docs) - 5)).otherwise("")
    inputs = F.concat(F.lit("Question: "), query, F.format_string("\n%d documents\n", F.size(docs)), _listed(docs), more)
    return _record(inputs, F.concat(F.format_string("First %d\n", F.size(ranked)), _listed(ranked)), F.format_string("change %.1f, length bias %.2f, overlap %.0f %%", change, length_bias, overlap * 100), told, score)


def generator_record(query: Column, context: Column, answer: Column, faithfulness: Column, accuracy: Column, score: Column, told: Column) -> Column:
    """An answer to reflect on: 500 characters of its context."""
    return _record(F.concat(F.lit("Question: "), query, F.lit("\nContext: "), T.preview(context, 500)), answer, F.format_string("faithfulness %.2f, accuracy %.2f", faithfulness, accuracy), told, score)


__all__ = ["GOOD", "PATTERN_ADVICE", "advice", "generator", "generator_record", "plain", "planner", "planner_record", "reranker", "reranker_record", "tier"]
