"""Reports of experiments: CSV, LaTeX, JSON. Tables of modules and configurations are small; scores by example are not and are written in parts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import write_text


def module_table(results: DataFrame) -> DataFrame:
    """Formatted columns of module, baseline, best (each with _ci_lower and _ci_upper), t_stat, p_value, is_significant."""
    gain = F.col("best") - F.col("baseline")
    pct = F.when(F.col("baseline") == 0, 0.0).otherwise(gain / F.col("baseline") * 100)
    ci = lambda c: F.format_string("[%.4f, %.4f]", f"{c}_ci_lower", f"{c}_ci_upper")
    return results.select(
        F.col("module").alias("Module"), F.format_string("%.4f", "baseline").alias("Baseline"), ci("baseline").alias("Baseline CI"), F.format_string("%.4f", "best").alias("Optimized"),
        ci("best").alias("Optimized CI"), F.format_string("%+.4f", gain).alias("Improvement"), F.format_string("%+.1f%%", pct).alias("Improvement %"),
        F.format_string("%.3f", "t_stat").alias("t-stat"), F.format_string("%.4f", "p_value").alias("p-value"), F.when(F.col("is_significant"), "Yes").otherwise("No").alias("Significant"),
    )


def ablation_table(results: DataFrame) -> DataFrame:
    """Formatted columns of config, score, ci_low, ci_high, gain, p_value, is_significant."""
    return results.select(
        F.col("config").alias("Configuration"), F.format_string("%.4f", "score").alias("Test Score"), F.format_string("[%.4f, %.4f]", "ci_low", "ci_high").alias("95% CI"),
        F.format_string("%+.4f", "gain").alias("vs Baseline"), F.format_string("%.4f", "p_value").alias("p-value"), F.when(F.col("is_significant"), "Yes").otherwise("No").alias("Significant"),
    )


def write_csv(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


_ESCAPED = str.maketrans({c: "\\" + c for c in "&%_#$"})


def latex(table: DataFrame, caption: str, label: str) -> str:
    """A LaTeX table of a small formatted table."""
    lines = [" & ".join(str(x).translate(_ESCAPED) for x in row) + r" \\" for row in [table.columns, *table.collect()]]
    body = "\n".join([lines[0], r"\midrule", *lines[1:]])
    return "\n".join([r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", r"\toprule", body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def write_json(spark: SparkSession, content: dict, path: str) -> None:
    write_text(spark, json.dumps(content, indent=2, default=str), path)


def sweep_report(results: DataFrame, best: DataFrame) -> dict:
    """What a sweep found, with its advice; read_chunk_size reads it again."""
    rows, top = [r.asDict() for r in results.orderBy("chunk_size").collect()], best.first().asDict()
    return {"results": rows, "best": top, "recommendation": f"Use --chunk_size {top['chunk_size']} --chunk_overlap {top['chunk_overlap']}"}


def write_examples(scores: DataFrame, path: str) -> None:
    """Scores by example, a folder for each config."""
    scores.write.mode("overwrite").partitionBy("config").json(path)
