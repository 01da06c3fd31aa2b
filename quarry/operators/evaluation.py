"""Rank metrics, labels, tuning and statistics over runs (query_id, doc_id, rank) and qrels (query_id, doc_id)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import storage

# Half-widths of a 95 % interval by sample size; 1.96 from 30 on, else 2.0.
T_TABLE = {2: 12.71, 3: 4.30, 4: 3.18, 5: 2.78, 10: 2.26, 15: 2.13, 20: 2.09, 25: 2.06}
WEIGHTS = [i / 10 for i in range(11)]
QUERY_WEIGHTS = [0.0, 0.3, 0.5, 0.7, 0.9, 1.0]


#: Bytes of items' texts in one automaton.
BLOCK_BYTES = 16 << 20


def containment_qrels(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, doc_id where a document holds an item's text: a pass over the texts for each block of items, by an automaton."""
    asked = items.where("text is not null and text <> ''").select("query_id", "text")
    size = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for k in range(blocks):
        part = _contained(docs, asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k))
        out = part if out is None else out.unionByName(part)
    return out


def _contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    import ahocorasick

    rows = [(r.query_id, r.text) for r in items.toLocalIterator()]
    held = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        automaton = ahocorasick.Automaton()
        by_text: dict[str, list] = {}
        for q, t in held.value:
            by_text.setdefault(t, []).append(q)
        for t, qs in by_text.items():
            automaton.add_word(t, qs)
        if by_text:
            automaton.make_automaton()
        for batch in batches:
            qs, ds = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {q for _, x in automaton.iter(t) for q in x} if t and by_text else ()
                qs += found
                ds += [d] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(ds, pa.int64())], ["query_id", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "query_id long, doc_id long")


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _ideal(n: Column) -> Column:
    """DCG of n relevant results in a row."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))).otherwise(0.0)


def rank_metrics(run: DataFrame, qrels: DataFrame, k: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Per labelled query: precision, recall, f1, mrr, ndcg, map of the first k results; queries without results score 0.

    Labels hold for every configuration of ``by``, or have its columns too.
    """
    keys, own = [*by, "query_id"], [c for c in by if c in qrels.columns]
    n_rel = qrels.groupBy(*own, "query_id").agg(F.countDistinct("doc_id").alias("n_rel"))
    judged = run if k is None else run.where(F.col("rank") <= k)
    judged = judged.join(qrels.distinct().withColumn("rel", F.lit(1)), [*own, "query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    hits = F.sum("rel").over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    judged = judged.withColumn("hits", hits)
    summed = judged.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("rel").alias("hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.col("rel") * F.col("hits") / F.col("rank")).alias("ap"),
    )
    base = n_rel if len(own) == len(by) else run.select(*by).distinct().crossJoin(n_rel)  # few configurations
    out = base.join(summed, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.col("hit") / F.col("n")), zero(F.col("hit") / F.col("n_rel"))
    ideal = _ideal(F.least(F.col("n_rel"), F.lit(k) if k else F.coalesce("n", F.lit(0))))
    return out.select(
        *keys, p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), zero(1 / F.col("first")).alias("mrr"),
        F.when(ideal > 0, zero(F.col("dcg")) / ideal).otherwise(0.0).alias("ndcg"), zero(F.col("ap") / F.col("n_rel")).alias("map"),
    )


def metrics_at(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """hits, precision and recall at each k; precision divides by k even where the list is shorter."""
    n_rel = qrels.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_rel"))
    judged = run.join(qrels.distinct().withColumn("rel", F.lit(1)), ["query_id", "doc_id"])
    summed = judged.groupBy("query_id").agg(*[F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"h{k}") for k in ks])
    out = n_rel.join(summed, "query_id", "left")
    cols = []
    for k in ks:
        h = F.coalesce(f"h{k}", F.lit(0))
        cols += [h.cast("long").alias(f"hits_at_{k}"), (h / k).alias(f"precision_at_{k}"), (h / F.col("n_rel")).alias(f"recall_at_{k}")]
    return out.select("query_id", *cols)


def improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two metric tables by query; overall is the mean of those of precision, ndcg and mrr."""
    names = ["precision", "recall", "ndcg", "mrr"]
    joined = before.select("query_id", *[F.col(x).alias(f"b_{x}") for x in names]).join(after.select("query_id", *[F.col(x).alias(f"a_{x}") for x in names]), "query_id")
    delta = {x: F.col(f"a_{x}") - F.col(f"b_{x}") for x in names}
    return joined.select("query_id", *[d.alias(f"{x}_delta") for x, d in delta.items()], ((delta["precision"] + delta["ndcg"] + delta["mrr"]) / 3).alias("overall"))


def interval(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, sample deviation and 95 % interval; fewer than two values have no width."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.when(F.col("n") >= 30, 1.96)
    for n, width in T_TABLE.items():
        t = t.when(F.col("n") == n, width)
    margin = F.when(F.col("n") >= 2, t.otherwise(2.0) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return out.select(*by, "n", "mean", F.coalesce("sd", F.lit(0.0)).alias("std"), (F.col("mean") - margin).alias("ci_low"), (F.col("mean") + margin).alias("ci_high"))


def paired_t(df: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, t and the approximate p of the differences a - b; fewer than two pairs give (0, 1)."""
    d = df.select(*by, (F.col(a) - F.col(b)).alias("d")).groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.when(F.col("n") < 2, 0.0).when(F.col("s") == 0, F.when(F.col("m") != 0, float("inf")).otherwise(0.0)).otherwise(F.col("m") / (F.col("s") / F.sqrt("n")))
    ratio = F.abs(t) / (F.abs(t) + F.col("n") - 1)
    p = F.when(F.col("n") < 2, 1.0).when(F.col("s") == 0, F.when(F.col("m") != 0, 0.0).otherwise(1.0)).otherwise(2 * (1 - F.least(F.lit(0.9999), ratio)))
    return d.select(*by, "n", t.alias("t_stat"), p.alias("p_approx"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def pattern(p: Column, r: Column, ndcg: Column, mrr: Column) -> Column:
    """What a query's metrics tell of its retrieval, the first rule that fits."""
    return (
        F.when((p > 0.6) & (r < 0.3), "precise, low coverage").when((p < 0.3) & (r > 0.5), "broad, decent coverage").when((p < 0.3) & (r < 0.3), "off topic")
        .when((ndcg < 0.7 * mrr) & (mrr > 0.3), "good first hit, poor tail").when((ndcg > 0.5) & (r < 0.5), "good ranking, incomplete").otherwise("mixed")
    )


def split(queries: DataFrame, seed: int = 42, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """train, validation and test by a seeded order: sizes are floors of the shares, the rest is test."""
    ordered = queries.withColumn("__hash", F.xxhash64("query_id", F.lit(seed))).repartitionByRange("__hash", "query_id").sortWithinPartitions("__hash", "query_id")
    ordered = storage.write(ordered.withColumn("__at", F.monotonically_increasing_id()), "split")  # part and place in it
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before, n = [], 0
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a task
        before.append(f"WHEN {r.part} THEN {n}")
        n += r["count"]
    bounds = [int(n * shares[0]), int(n * shares[0]) + int(n * shares[1])]
    first = F.expr(f"CASE shiftright(__at, 33) {' '.join(before)} END") if before else F.lit(0)
    at = first + place
    return ordered.withColumn("split", F.when(at < bounds[0], "train").when(at < bounds[1], "validation").otherwise("test")).drop("__hash", "__at")
