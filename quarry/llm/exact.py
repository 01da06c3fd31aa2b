"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

1. Lengths: byte lengths that several texts have. Nothing of a text is hashed.
2. Prefixes: of texts of such a length, pairs of length and prefix hash that several have.
3. Full content: only texts of such a pair are hashed whole, and grouped by that.

Each step is a scan that no text leaves, and a partial aggregation, so a group of copies that holds a
third of all rows reaches its reducer as one row a map task. What a step keeps is broadcast to the next
scan while it is small; beyond that bound the next step hashes all rows, which gives the same groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, join_counted, materialize, whole

#: Characters that the prefix hash covers.
PREFIX = 256


def _candidates(docs: DataFrame, id_col: str, text_col: str, prefix: int, most: int) -> DataFrame:
    """doc_id, len, sha, text_key of the rows whose length and prefix another row has as well (and of more, beyond the bound)."""
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.octet_length(text).alias("len"))
    lengths = materialize(rows.groupBy(F.col("len").alias("l_len")).agg(F.count("*").alias("n")).where("n > 1").select("l_len"), "lengths")
    if lengths.count() <= most:
        rows = rows.join(F.broadcast(lengths), F.col("len") == F.col("l_len"), "left_semi")
    rows = rows.withColumn("pre", F.xxhash64(F.substring("t", 1, prefix)))
    pairs = materialize(rows.groupBy(F.col("len").alias("p_len"), F.col("pre").alias("p_pre")).agg(F.count("*").alias("n")).where("n > 1").select("p_len", "p_pre"), "prefixes")
    if pairs.count() <= most:
        rows = rows.join(F.broadcast(pairs), (F.col("len") == F.col("p_len")) & (F.col("pre") == F.col("p_pre")), "left_semi")
    return materialize(rows.select("doc_id", "len", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), F.xxhash64("t").alias("text_key")), "candidates")


def _groups(candidates: DataFrame) -> DataFrame:
    """g_sha, g_len, keep, n of the groups of two rows or more."""
    groups = candidates.groupBy(F.col("sha").alias("g_sha"), F.col("len").alias("g_len")).agg(F.max("doc_id").alias("keep"), F.count("*").alias("n"))
    return materialize(groups.where("n > 1"), "groups")


_ON = [("sha", "g_sha"), ("len", "g_len")]


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_key (a 64-bit hash of the text), keep_id, group_size of every row whose text another row has; see exact_dedup."""
    found = _candidates(docs, id_col, text_col, prefix, most)
    return join_counted(found, _groups(found), _ON, "n").select("doc_id", "text_key", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, most: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text, which forms a group like
    any other. Of a group the largest id stays; null ids are below all others, and where all are
    null keep_id is null and the rows stay. Rows that repeat both id and text share one decision
    and each counts in group_size. An empty table gives an empty one; further columns are ignored.
    The digests of texts without copies are reported, and decide nothing.
    """
    text = whole(text_col)
    groups = _groups(_candidates(docs, id_col, text_col, prefix, most))
    light = materialize(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).alias("len"), F.sha2(text.cast("binary"), 256).alias("sha")), "digests")
    joined = join_counted(light, groups, _ON, "n", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
