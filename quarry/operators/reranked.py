"""A reranked list of texts against the list before it: which document each text is, and where the lists differ.

before has query_id, rank, doc_id, text; after has query_id, rank, text. Texts are equal after white space is squeezed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

#: The id of a text that was not in the list.
UNKNOWN = -1


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with the text's key and how many equal texts its list has up to here."""
    keyed = rows.withColumn("key", T.doc_key(F.coalesce("text", F.lit(""))))
    return keyed.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("rank")))


def match(before: DataFrame, after: DataFrame, unknown=UNKNOWN) -> DataFrame:
    """query_id, rank, doc_id, was of each text of the list after: the nth of equal texts is the nth before.

    A text that the list before has not, or not as often, has the id ``unknown`` and no place before (was null).
    """
    old = _numbered(before).select("query_id", "key", "nth", F.col("doc_id").alias("of"), F.col("rank").alias("was"))
    found = _numbered(after).select("query_id", "key", "nth", "rank").join(old, ["query_id", "key", "nth"], "left")
    return found.select("query_id", "rank", F.when(F.col("was").isNull(), F.lit(unknown)).otherwise(F.col("of")).alias("doc_id"), "was")


def changed(before: DataFrame, after: DataFrame, first: int = 5) -> DataFrame:
    """query_id, n_changed, n_left: of the first places how many hold another text after, and how many of the texts there have left them.

    A place that only one of the lists has counts as changed.
    """
    side = lambda rows, name: _numbered(rows.where(F.col("rank") <= first)).select("query_id", "rank", F.col("key").alias(name))
    places = side(before, "a").join(side(after, "b"), ["query_id", "rank"], "full")
    counted = places.groupBy("query_id").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"))
    kept = _numbered(before.where(F.col("rank") <= first)).join(_numbered(after.where(F.col("rank") <= first)).select("query_id", "key", "nth"), ["query_id", "key", "nth"], "left_anti")
    left = kept.groupBy(F.col("query_id").alias("q")).agg(F.count("*").alias("n"))
    return counted.join(left, F.col("query_id") == F.col("q"), "left").select("query_id", "n_changed", F.coalesce("n", F.lit(0).cast("long")).alias("n_left"))
