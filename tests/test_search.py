import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import storage
from quarry.functions import text as T
from quarry.operators import impacts
from quarry.operators import search as S


def _dense_by_hand(vectors, queries, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    out = set()
    for q, v in queries:
        scores = sorted((-round(round(float(unit(v) @ unit(x)), 12), 9), d) for d, x in vectors)[:k]
        out |= {(q, d, r + 1) for r, (_, d) in enumerate(scores)}
    return out


@pytest.mark.parametrize("limits", [{}, {"block": 3}, {"block": 4, "vector_bytes": 8 * 5 * 7}])
def test_grid_equals_brute_force(spark, limits):
    rng = np.random.default_rng(1)
    vectors = [(int(i), rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(60)]  # many ties
    queries = [(f"q{i}", rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(11)]
    v = spark.createDataFrame(vectors, "doc_id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    got = {(r.query_id, r.doc_id, r["rank"]) for r in S.dense(v, q, 6, **limits).collect()}
    assert got == _dense_by_hand(vectors, queries, 6)


@pytest.mark.parametrize("block", [100, 2])
def test_groups_are_searched_apart(spark, block):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), f"d{i:02d}", rng.standard_normal(4).tolist()) for i in range(40)]
    queries = [(int(i), rng.standard_normal(4).tolist()) for i in range(5)]
    v = spark.createDataFrame(rows, "g int, doc_id string, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = {(r.g, r.query_id, r.doc_id, r["rank"]) for r in S.dense(v, q, 3, block=block, by="g").collect()}
    held = [(r.g, r.doc_id, [float(x) for x in r.embedding]) for r in v.collect()]
    asked = [(r.query_id, [float(x) for x in r.embedding]) for r in q.collect()]
    assert got == {(g, *x) for g in range(3) for x in _dense_by_hand([(d, e) for h, d, e in held if h == g], asked, 3)}


def test_missing_vectors_have_a_status_and_cost_no_other(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert {r.query_id: r.status for r in S.dense_statuses(v, q).collect()} == {1: "success", 2: "missing", 3: "invalid", 4: "invalid", 5: "success"}
    assert sorted((r.query_id, r.doc_id) for r in S.dense(v, q, 5).collect()) == [(1, 1), (1, 2), (5, 1), (5, 2)]
    assert S.dense(v.limit(0), q, 5).collect() == [] and S.dense(v, q.limit(0), 5).collect() == [] and S.dense(v, q.where("query_id = 2"), 5).collect() == []


def _bm25_by_hand(docs, queries, k, positive):
    """Every document scored for every query."""
    n, tf = len(docs), {d: {t: ts.count(t) for t in ts} for d, ts in docs.items()}
    df = {}
    for ts in tf.values():
        for t in ts:
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in raw.items()}
    average = sum(map(len, docs.values())) / n
    out = set()
    for q, words in queries.items():
        scores = {d: sum(idf[t] * tf[d][t] * 2.5 / (tf[d][t] + 1.5 * (0.25 + 0.75 * len(docs[d]) / average)) for t in words if t in tf[d]) for d in docs}
        kept = sorted((-round(s, 9), d) for d, s in scores.items() if s > 0 or not positive)[:k]
        out |= {(q, d, r + 1) for r, (_, d) in enumerate(kept)}
    return out


def _texts(seed, common):
    """common: how many words nearly all texts have; many of them make the mean idf negative."""
    rng = random.Random(seed)
    return {f"d{i:02d}": [w for w in [f"common{j}" for j in range(common)] if rng.random() < 0.9] + [f"word{rng.randrange(9)}" for _ in range(rng.randrange(4))] for i in range(30)}


@pytest.mark.parametrize("common", [1, 30])
@pytest.mark.parametrize("positive", [True, False])
def test_bm25_against_every_score(spark, common, positive):
    docs = _texts(common, common)
    queries = {1: ["word1", "common0"], 2: ["common0"], 3: ["nobody"], 4: ["word2", "word2", "word3"]}
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id string, text string")
    q = spark.createDataFrame([(i, " ".join(ws)) for i, ws in queries.items()], "query_id long, text string")
    got = {(r.query_id, r.doc_id, r["rank"]) for r in S.bm25(d, q, 8, T.tokens_raw, positive).collect()}
    assert got == _bm25_by_hand(docs, queries, 8, positive)


def test_bm25_by_group_equals_each_alone(spark):
    docs = {g: _texts(g, 2 + g) for g in range(3)}
    queries = {1: ["word1", "common0"], 2: ["common0", "word5"], 3: ["nobody"]}
    d = spark.createDataFrame([(g, i, " ".join(ws)) for g, some in docs.items() for i, ws in some.items()], "g int, doc_id string, text string")
    q = spark.createDataFrame([(i, " ".join(ws)) for i, ws in queries.items()], "query_id long, text string")
    for positive in (True, False):
        got = {(r.g, r.query_id, r.doc_id, r["rank"]) for r in S.bm25_by(d, q, "g", 6, T.tokens_raw, positive).collect()}
        assert got == {(g, *x) for g, some in docs.items() for x in _bm25_by_hand(some, queries, 6, positive)}


def test_salted_terms_change_nothing(spark, monkeypatch):
    docs = _texts(3, 4)
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id string, text string")
    q = spark.createDataFrame([(i, f"word{i} common0 common1") for i in range(8)], "query_id long, text string")
    want = sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in S.bm25(d, q, 5).collect())
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(S, "HOT_POSTINGS", 4)
    assert sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in S.bm25(d, q, 5).collect()) == want


def _long_tail(seed, n=400):
    rng = random.Random(seed)
    pick = lambda: f"w{int(rng.paretovariate(0.7))}"
    return {f"d{i:03d}": [pick() for _ in range(rng.randrange(5, 60))] for i in range(n)}


@pytest.mark.parametrize("k", [3, 10])
def test_impacts_give_the_same_best(spark, k):
    """As every score does, while queries of a rare and a common word read part of their postings."""
    docs = _long_tail(k)
    queries = {1: ["w200", "w1"], 2: ["w1", "w2", "w3"], 3: ["w37", "w1", "w2"], 4: ["nobody"], 5: ["w1"], 6: ["w5", "w5", "w90", "w1"]}
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id string, text string")
    q = spark.createDataFrame([(i, " ".join(ws)) for i, ws in queries.items()], "query_id long, text string")
    made = impacts.Impacts.build(S.Index.build(d, T.tokens_raw))
    got = {(r.query_id, r.doc_id, r["rank"]) for r in impacts.bm25(made, q, k, T.tokens_raw).collect()}
    assert got == _bm25_by_hand(docs, queries, k, True) and made.safe
    told = {r.query_id: r for r in impacts.report(made, q, k, T.tokens_raw).collect()}
    n = lambda word: sum(word in ws for ws in docs.values())
    assert {x: r.n_postings for x, r in told.items()} == {x: sum(n(w) for w in set(ws)) for x, ws in queries.items() if any(n(w) for w in ws)}
    assert all(r.n_read <= r.n_postings for r in told.values()) and sum(r.n_read for r in told.values()) < 0.8 * sum(r.n_postings for r in told.values())
    print({x: (r.n_read, r.n_postings) for x, r in told.items()})


def test_impacts_without_a_bound(spark, monkeypatch):
    """Where weights are negative all levels are read."""
    docs = _texts(30, 30)
    queries = {1: ["word1", "common0"], 2: ["common0"]}
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id string, text string")
    q = spark.createDataFrame([(i, " ".join(ws)) for i, ws in queries.items()], "query_id long, text string")
    made = impacts.Impacts.build(S.Index.build(d, T.tokens_raw))
    assert not made.safe
    assert {(r.query_id, r.doc_id, r["rank"]) for r in impacts.bm25(made, q, 5, T.tokens_raw).collect()} == _bm25_by_hand(docs, queries, 5, True)


def test_all_statistics_against_counts(spark):
    """Every term's count and idf, with words that most texts have and words that one has."""
    docs = _texts(5, 12)
    index = S.Index.build(spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id string, text string"))
    df = {t: sum(t in ws for ws in docs.values()) for ws in docs.values() for t in ws}
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    want = {t: (df[t], round(x if x >= 0 else 0.25 * mean, 9)) for t, x in raw.items()}
    assert {r.term: (r.df, round(r.idf, 9)) for r in index.stats.collect()} == want
    assert index.average == pytest.approx(sum(map(len, docs.values())) / len(docs)) and index.mean == pytest.approx(mean)


def test_places(spark):
    rows = spark.createDataFrame([(i % 3, f"k{(i * 7) % 50:02d}") for i in range(50)], "g int, k string").repartition(6)
    assert [r.k for r in storage.place(rows, "k").orderBy("place").collect()] == sorted(r.k for r in rows.collect())
    for g in range(3):
        got = storage.place(rows, "k", by="g").where(F.col("g") == g).orderBy("place").collect()
        assert [r.place for r in got] == list(range(len(got))) and [r.k for r in got] == sorted(r.k for r in got)


def test_a_shared_table_is_made_again_where_it_was_cleared(spark, tmp_path):
    import shutil

    made = []
    spark.range(3).write.parquet(f"{tmp_path}/in")
    make = lambda: made.append(1) or spark.range(5)
    first = storage.once(spark, f"{tmp_path}/in", "x", make)
    assert storage.once(spark, f"{tmp_path}/in", "x", make).count() == 5 and len(made) == 1 and storage.alive(first)
    folder = first.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    shutil.rmtree("/" + folder.lstrip("/"))
    assert not storage.alive(first) and storage.once(spark, f"{tmp_path}/in", "x", make).count() == 5 and len(made) == 2


def test_registered_statistics_have_every_term(spark):
    from quarry import catalog

    d = "/root/testdata/sf0.001"
    words = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term")).distinct().count()
    got = catalog.queries()["bm25_stats"](spark, d)
    assert got.columns == ["term", "df", "idf"] and got.count() == words


@pytest.mark.parametrize("positive", [True, False])
def test_queries_go_to_the_documents(spark, monkeypatch, positive):
    """In steps of few documents, with many ties, as against every score; no score is kept but those of the best."""
    docs = _texts(7, 3)
    queries = {i: [f"word{i % 9}", f"common{i % 3}"] for i in range(12)} | {20: ["nobody"]}
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id string, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(ws)) for i, ws in queries.items()], "query_id long, text string")
    index, written = S.Index.build(d, T.tokens_raw), []
    keep = storage.write
    monkeypatch.setattr(S, "CELLS", 4 * len(queries))
    monkeypatch.setattr(storage, "write", lambda df, name: written.append(name) or keep(df, name))
    got = {(r.query_id, r.doc_id, r["rank"]) for r in S.bm25(index, q, 5, T.tokens_raw, positive).collect()}
    assert got == _bm25_by_hand(docs, queries, 5, positive) and written == ["query-terms"]


def test_a_shorter_list_is_the_head_of_the_longest(spark):
    from quarry import catalog

    d = "/root/testdata/sf0.001"
    rows = lambda run: {(r.query_id, r.doc_id, r["rank"]) for r in run.collect()}
    long = rows(catalog._bm25(spark, d))
    assert rows(catalog._bm25(spark, d, k=5)) == {x for x in long if x[2] <= 5}
    assert catalog._bm25(spark, d, k=5).inputFiles() == catalog._bm25(spark, d).inputFiles()


def test_terms_are_counted_in_their_row(spark, monkeypatch):
    """In order, each with its count, whatever shares a step; no text and no word give an empty list."""
    monkeypatch.setattr(S, "COUNTED", 3)
    texts = ["b a b", None, "", "Éa éa zz", "a", "...", "zz zz zz b"] * 2
    rows = S.terms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), T.tokens_raw).collect()
    words = {i: [w for w in (t or "").lower().split() if len(w) > 1] for i, t in enumerate(texts)}
    assert {r.doc_id: (r.dl, [(t.term, t.tf) for t in r.terms]) for r in rows} == {i: (len(ws), sorted((w, ws.count(w)) for w in set(ws))) for i, ws in words.items()}


def test_impacts_keep_no_score_and_no_candidate(spark, monkeypatch):
    """Blocks of few documents and parts of few queries, with many ties, as against every score; of a search the query's terms alone are written."""
    docs = _texts(7, 3)
    queries = {i: [f"word{i % 9}", f"common{i % 3}"] for i in range(12)} | {20: ["nobody"]}
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id string, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(ws)) for i, ws in queries.items()], "query_id long, text string")
    monkeypatch.setattr(S, "COUNTED", 2)
    monkeypatch.setattr(S, "BLOCK", 5)
    monkeypatch.setattr(impacts, "POSTINGS", 12, raising=False)
    made, written, keep = impacts.Impacts.build(S.Index.build(d, T.tokens_raw)), [], storage.write
    monkeypatch.setattr(storage, "write", lambda df, name: written.append(name) or keep(df, name))
    got = {(r.query_id, r.doc_id, r["rank"]) for r in impacts.bm25(made, q, 5, T.tokens_raw).collect()}
    assert got == _bm25_by_hand(docs, queries, 5, True) and written == ["query-terms"]
    assert made.postings.select("block").distinct().count() > 5
    assert impacts.bm25(made, q.where("query_id = 20"), 5, T.tokens_raw).collect() == []
