"""Scores built from metrics: end to end, per module, tiers of feedback, reflection records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.evaluation import f1

# Stand-ins for missing inputs, tiers (high, low) and weights of each score.
NO_CONTEXT, NO_ANSWER, NO_QUERY = "No context retrieved.", "No answer generated.", "No query provided."
TIERS = {"planner": (0.5, 0.2), "reranker": (0.5, 0.2), "generator": (0.6, 0.3)}
END_TO_END = {"retrieval_f1": 0.3, "context_f1": 0.2, "generation_quality": 0.5}


def contexts_or_default(contexts: Column) -> Column:
    """The contexts that aren't blank; the stand-in alone where there are none."""
    kept = F.filter(contexts, lambda c: c.isNotNull() & (T.strip(c) != ""))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(F.lit(NO_CONTEXT)))


def text_or_default(c: Column, default: str) -> Column:
    return F.when(T.strip(F.coalesce(c, F.lit(""))) != "", c).otherwise(default)


def generation_quality(faithfulness: Column, accuracy: Column) -> Column:
    return (F.coalesce(faithfulness, F.lit(0.0)) + F.coalesce(accuracy, F.lit(0.0))) / 2


def end_to_end(retrieval_precision: Column, retrieval_recall: Column, context_precision: Column, context_recall: Column, faithfulness: Column, accuracy: Column) -> Column:
    """Weighted quality; a null retrieval metric means the context's F1 in its place, any other null is 0."""
    context = f1(F.coalesce(context_precision, F.lit(0.0)), F.coalesce(context_recall, F.lit(0.0)))
    known = retrieval_precision.isNotNull() & retrieval_recall.isNotNull()
    retrieval = F.when(known, f1(retrieval_precision, retrieval_recall)).otherwise(context)
    return END_TO_END["retrieval_f1"] * retrieval + END_TO_END["context_f1"] * context + END_TO_END["generation_quality"] * generation_quality(faithfulness, accuracy)


def planner_score(metric: Column) -> Column:
    """The chosen metric (ndcg, mrr or f1); one half for queries without labels."""
    return F.coalesce(metric, F.lit(0.5))


def reranker_score(ndcg: Column, mrr: Column, precision_at_5: Column) -> Column:
    return 0.6 * ndcg + 0.2 * mrr + 0.2 * precision_at_5


def tier(score: Column, module: str) -> Column:
    high, low = TIERS[module]
    return F.when(score >= high, "positive").when(score >= low, "partial").otherwise("negative")


def rank_scores(n: Column) -> Column:
    """1, 1 - 1/n, ...: the scores of a ranked list of n."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: 1 - i / n)).otherwise(F.array().cast("array<double>"))


def fallback_scores(n: Column) -> Column:
    """1, 1/2, 1/3, ...: the scores of a list that could not be ranked."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: 1 / i)).otherwise(F.array().cast("array<double>"))


def clamp(weight: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))


def improvement_pct(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0.0).otherwise((after - before) / before * 100)


def reflection(module: str, inputs: Column, outputs: Column, analysis: Column, score: Column) -> Column:
    """What a prompt optimiser reads of one example."""
    advice = {"planner": "Search terms decide what is found", "reranker": "The order decides what the answer sees", "generator": "The answer must rest on its context"}[module]
    said = F.when(tier(score, module) == "positive", "Good result; keep this way.").when(tier(score, module) == "partial", advice + ": part of it is right.").otherwise(advice + ": this failed.")
    return F.struct(T.preview(inputs, 500).alias("Inputs"), T.preview(outputs, 500).alias("Generated Outputs"), analysis.alias("Analysis"), F.concat(said, F.lit(" "), analysis).alias("Feedback"), F.format_string("%.3f", score).alias("Score"))


def bias_note(bias: Column, overlap: Column) -> Column:
    """Words on a ranked list's length bias and on how much of the query its first documents hold."""
    length = F.when(bias > 0.65, "long documents come first").when(bias < 0.35, "short documents come first").otherwise("length has no say")
    words = F.when(overlap > 0.6, "the query's words are met").when(overlap < 0.3, "few of the query's words are met").otherwise("some of the query's words are met")
    return F.concat_ws("; ", length, words)


def answer_note(faithfulness: Column, accuracy: Column) -> Column:
    """What differing faithfulness and accuracy tell."""
    return F.when((faithfulness >= 0.6) & (accuracy < 0.3), "rests on its context, but that doesn't answer").when((faithfulness < 0.3) & (accuracy >= 0.6), "right, but not from its context").when((faithfulness < 0.3) & (accuracy < 0.3), "neither rests on its context nor answers").otherwise("no clear fault")
