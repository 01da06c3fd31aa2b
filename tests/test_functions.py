from pyspark.sql import functions as F
import pytest

from quarry.functions import chunking
from quarry.functions import text as T
from quarry.operators import evaluation as E


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, "A Éa_b, x 12; 😀 no break -- z9", T.tokens(F.col("t"))) == ["éa_b", "12", "no", "break", "z9"]
    assert one(spark, "Hi, a you!", T.tokens_raw(F.col("t"))) == ["hi,", "you!"]


def test_normalize_and_keys(spark):
    assert one(spark, " a1b\n\n 22 ", T.normalize(F.col("t"))) == "a 1 b 2 2"
    assert one(spark, "", T.doc_key(F.col("t"))) == ""


def chunks(spark, text, size, overlap, kind):
    return one(spark, text, chunking.chunks("t", size, overlap, kind))


def test_chunk_edges(spark):
    assert chunks(spark, "", 200, 10, "index") == [""]
    assert chunks(spark, "  ", 200, 10, "sweep") == []
    assert chunks(spark, "short 1", 200, 10, "index") == ["short 1"]
    with pytest.raises(ValueError):
        chunking.chunks("t", 100, 10, "index")


def test_chunk_marker_precedence(spark):
    text = "a" * 130 + ". " + "b" * 20 + "! " + "c" * 300
    assert chunks(spark, text, 200, 10, "index")[0] == "a" * 130 + "."
    assert chunks(spark, text, 200, 10, "sweep")[0] == "a" * 130 + ". " + "b" * 20 + "!"


def test_no_boundary_and_overlap(spark):
    got = chunks(spark, "x" * 500, 200, 50, "index")
    assert [len(c) for c in got] == [200, 200, 200]


def frames(spark, run, rel):
    r = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(run)], "query_id string, doc_id int, rank int")
    return r, spark.createDataFrame([("q", d) for d in rel], "query_id string, doc_id int")


def test_metrics(spark):
    m = E.rank_metrics(*frames(spark, [5, 1, 6, 2], [1, 2, 3])).first()
    assert (m.precision, m.recall, m.mrr) == (0.5, 2 / 3, 0.5)
    assert m.map == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert E.rank_metrics(*frames(spark, [1, 2], [1, 2])).first().ndcg == pytest.approx(1)


def test_empty_run_scores_zero(spark):
    _, rel = frames(spark, [1], [1])
    run = spark.createDataFrame([], "query_id string, doc_id int, rank int")
    m = E.rank_metrics(run, rel).first()
    assert (m.precision, m.ndcg, m.map) == (0, 0, 0)


def test_interval_and_t(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "a double, b double")
    assert E.interval(df, "a").first().ci_high == pytest.approx(1.5 + 12.71 * 0.5**0.5 / 2**0.5)
    same = spark.createDataFrame([(1.0, 0.0), (1.0, 0.0)], "a double, b double")
    assert tuple(E.paired_t(same, "a", "b").first())[1:] == (float("inf"), 0.0)
    assert tuple(E.paired_t(df.limit(1), "a", "b").first())[1:] == (0.0, 1.0)


def test_import_without_extras():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
