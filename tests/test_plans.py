import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import sampling
from quarry.operators import scoring as C
from quarry.plans import models, rag, reports
from quarry.sources import tables

RETRY = {"tries": 1, "delay": 0.0}


class Broken:
    def ask(self, task, prompt, text):
        raise RuntimeError("down")


def docs(spark):
    return spark.createDataFrame([(1, "Cats sleep all day. They eat fish."), (2, "Dogs run in the park."), (3, "Fish swim in the sea."), (4, None), (5, "Birds sing at dawn.")], "doc_id long, text string")


def asked(spark):
    return spark.createDataFrame([(1, "what do cats eat? where do dogs run"), (2, "zebra")], "query_id long, text string")


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": "a", "content": "x"}, {"doc_id": "b", "text": "ready", "chunk_id": "c9", "parent_doc_id": "p"}, {"doc_id": "n"}]))
    (tmp_path / "l.json").write_text(json.dumps({"1": ["a", "a"], "2": []}))
    d = tables.read_documents(spark, f"file://{tmp_path}/d.json")
    chunks = tables.chunk_documents(d, 200, 10)
    assert {(r.chunk_id, r.doc_id, r.chunk) for r in chunks.collect()} == {("a_chunk_00", "a", "x"), ("c9", "p", "ready")}
    assert [tuple(r) for r in tables.read_labels(spark, f"file://{tmp_path}/l.json").collect()] == [("1", "a")]
    q = spark.createDataFrame([("1", ["c9", "zz"], ["a"]), ("2", None, ["a", "c9"]), ("3", [], ["none"])], "query_id string, reference_chunk_ids array<string>, reference_doc_ids array<string>")
    assert {tuple(r) for r in tables.resolve_labels(q, chunks).collect()} == {("1", "c9"), ("2", "a_chunk_00"), ("2", "c9")}


def test_checkpoints_and_prompts(spark, tmp_path):
    at = f"file://{tmp_path}/cp"
    assert tables.load_checkpoint(spark, at, 1, {}) is None
    tables.save_checkpoint(spark, at, 1, {"ids": ["2", "9", "1"], "prompt": "two\nlines\n"}, {"a": 1})
    state = tables.load_checkpoint(spark, at, 1, {"a": 1})
    assert state["ids"] == ["2", "9", "1"] and state["prompt"] == "two\nlines\n"
    with pytest.warns(UserWarning):
        tables.load_checkpoint(spark, at, 1, {"a": 2})
    assert [r.query_id for r in tables.restore_queries(asked(spark), state["ids"]).collect()] == [2, 1]


def test_cache_is_of_its_content(spark, tmp_path):
    made = []

    def make(chunks):
        made.append(1)
        return models.embed(chunks, lambda ts: [[float(len(t))] for t in ts], 1)

    a = spark.createDataFrame([("a", "xx"), ("b", " "), ("c", None)], "chunk_id string, chunk string")
    for table in (a, a, a.withColumn("chunk", F.lit("other"))):
        got = {r.chunk_id: r.embedding for r in tables.cached_embeddings(spark, f"file://{tmp_path}/e", 512, table, "m", 51, make).collect()}
    assert len(made) == 2 and got["a"] == [5.0]
    assert {r.chunk_id: r.embedding for r in make(a).collect()} == {"a": [2.0], "b": [0.0], "c": [0.0]}


def test_lookup_takes_the_first(spark):
    left = spark.createDataFrame([("a",), ("z",), ("",)], "k string")
    right = spark.createDataFrame([("a", 5), ("a", 3), ("", 1)], "k string, pos int")
    assert {r.k: r.pos for r in tables.lookup(left, right, "k", "pos", "pos").collect()} == {"a": 3, "z": -1, "": -1}


def test_answers(spark):
    got = {r.query_id: r for r in rag.answer(asked(spark), docs(spark), models.RuleClient(), **RETRY).collect()}
    assert got[1].status == "success" and "Cats" in got[1].documents[0] + got[1].documents[1]
    assert list(got[2].documents) == [] and got[2].answer == ""


def test_failures_keep_rows(spark):
    planned = models.plan(asked(spark), Broken(), **RETRY)
    assert {(r.query_id, tuple(r.queries), r.mode, r.status) for r in planned.collect()} == {(1, ("what do cats eat? where do dogs run",), "reformulation", "error"), (2, ("zebra",), "reformulation", "error")}
    lists = spark.createDataFrame([(1, "q", [7, 8], ["a", "b"]), (2, "q", [], [])], "query_id long, text string, doc_ids array<long>, documents array<string>")
    kept = {r.query_id: r for r in models.rerank(lists, Broken(), **RETRY).collect()}
    assert list(kept[1].doc_ids) == [7, 8] and list(kept[1].scores) == [1.0, 0.5] and kept[2].status == "success"
    assert rag.evaluate(rag.answer(asked(spark), docs(spark), Broken(), **RETRY), asked(spark).withColumn("ground_truth", F.lit("x")), Broken(), **RETRY).count() == 0


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise ValueError("429 too many")
        return 7

    assert models.with_retry(call, sleep=waits.append) == 7 and waits == [1.0, 2.0, 4.0]


def test_evaluate(spark):
    truths = asked(spark).withColumn("ground_truth", F.lit("They eat fish."))
    got = rag.evaluate(rag.answer(asked(spark), docs(spark), models.RuleClient(), **RETRY), truths, models.RuleClient(), **RETRY).collect()
    assert [r.query_id for r in got] == [1] and 0 < got[0].overall_quality <= 1 and got[0].faithfulness == 1


def test_contextualize(spark):
    chunks = spark.createDataFrame([("1_chunk_00", 1, 0, "They eat fish.")], "chunk_id string, doc_id long, chunk_index int, chunk string")
    good, bad = (models.contextualize(chunks, docs(spark), c, **RETRY).first() for c in (models.RuleClient(), Broken()))
    assert good.has_context and good.contextualized.endswith("\n\nThey eat fish.") and not bad.has_context and bad.contextualized == "They eat fish."


def test_optimise_needs_strict_gain(spark):
    worth = {"a": 0.5, "ab": 0.5, "abb": 0.9}
    score = lambda p: spark.createDataFrame([(1, worth.get(p, 0.1))], "query_id int, score double")
    step = iter(["ab", "abb", "x"])
    assert rag.optimise("a", score, lambda best, s: next(step), 3) == ("abb", [("a", 0.5), ("ab", 0.5), ("abb", 0.9), ("x", 0.1)])


def test_elbow_and_representatives(spark):
    assert sampling.elbow([1.0, 2.0]) == 5
    assert sampling.elbow([100, 50, 10, 9, 8.5]) == 7
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "query_id long, embedding array<double>")
    assert sampling.representatives(few).count() == 4


def test_scores(spark):
    row = spark.range(1).select(
        C.end_to_end(*[F.lit(x).cast("double") for x in (None, None, 0.5, 0.5, 1.0, 0.0)]).alias("a"), C.rank_scores(F.lit(4)).alias("b"), C.fallback_scores(F.lit(0)).alias("c"),
        C.contexts_or_default(F.array(F.lit(" "), F.lit(None).cast("string"))).alias("d"), C.tier(F.lit(0.3), "generator").alias("e"), C.clamp(F.lit(1.5)).alias("f"),
    ).first()
    assert row.a == pytest.approx(0.5) and row.b == [1, 0.75, 0.5, 0.25] and row.c == [] and row.d == [C.NO_CONTEXT] and row.e == "partial" and row.f == 1


def test_sweep_report_round_trip(spark, tmp_path):
    d = docs(spark).where("text is not null").withColumn("text", F.repeat("text", 30))
    rel = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    found = rag.sweep(d, asked(spark), rel, (256, 512))
    report = reports.sweep_report(found, rag.best_size(found))
    reports.write_json(spark, report, f"file://{tmp_path}/r.json")
    assert tables.read_chunk_size(spark, f"file://{tmp_path}/r.json", 1, 1) == (report["best"]["chunk_size"], report["best"]["chunk_overlap"])
    with pytest.warns(UserWarning):
        assert tables.read_chunk_size(spark, f"file://{tmp_path}/none.json", 600, 50) == (600, 50)


def test_report_tables(spark, tmp_path):
    a = spark.createDataFrame([("x_1", 0.5, 0.4, 0.6, -0.1, 0.03, True)], "config string, score double, ci_low double, ci_high double, gain double, p_value double, is_significant boolean")
    table = reports.ablation_table(a)
    assert tuple(table.first()) == ("x_1", "0.5000", "[0.4000, 0.6000]", "-0.1000", "0.0300", "Yes")
    assert r"x\_1 & 0.5000" in reports.latex(table, "c", "t:l")
    reports.write_csv(table, f"file://{tmp_path}/csv")
    reports.write_examples(a.select("config", "score"), f"file://{tmp_path}/ex")
    assert spark.read.json(f"file://{tmp_path}/ex").first().config == "x_1"


def test_registered_sweep_tries_every_size(spark):
    from quarry import catalog

    found = catalog.queries()["chunk_size_sweep"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.chunk_size, r.chunk_overlap) for r in found) == [(256, 25), (512, 51), (1024, 102), (2048, 204)]
    best = catalog.queries()["chunk_size_best"](spark, "/root/testdata/sf0.001").first()
    assert best.chunk_size == min(found, key=lambda r: (-r.ndcg, r.chunk_size)).chunk_size


def test_sweep_keeps_no_texts_and_no_postings(spark, monkeypatch):
    """Chunks of all sizes are several times the texts: of what is written none has a chunk's text, terms or every score."""
    from quarry import storage

    written, keep = {}, storage.write
    monkeypatch.setattr(storage, "write", lambda df, name: written.update({name: df.columns}) or keep(df, name))
    d = docs(spark).where("text is not null").withColumn("text", F.repeat("text", 30))
    assert rag.sweep(d, asked(spark), spark.createDataFrame([(1, 1)], "query_id long, doc_id long"), (256, 512)).count() == 2
    assert not {"terms", "scores"} & set(written) and not any({"chunk", "terms"} & set(c) for c in written.values())
