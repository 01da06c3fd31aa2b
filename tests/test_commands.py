import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import chunking
from quarry.functions import text as T
from quarry.plans import commands, models
from quarry.plans import experiment as X

TEXTS = ["Cats sleep all day. They eat fish.", "Dogs run in the park. They bark.", "Fish swim in the sea.", "Birds sing at dawn.", "Horses run fast on grass."]


def _encode(texts):
    return [[float(t.lower().count(c)) + 0.1 for c in "aeiou"] for t in texts]


def _write(folder, n=12):
    (folder / "documents.json").write_text(json.dumps([{"doc_id": f"d{i}", "text": (t + " ") * 12} for i, t in enumerate(TEXTS)]))
    asked = [{"query_id": str(i), "query": f"about {TEXTS[i % 5].split()[0]} {TEXTS[i % 5].split()[1]} {i}", "ground_truth": TEXTS[i % 5]} for i in range(n)]
    (folder / "queries.json").write_text(json.dumps(asked))
    (folder / "relevance_labels.json").write_text(json.dumps({str(i): [f"d{i % 5}"] for i in range(n)}))


def test_optimize(spark, tmp_path):
    _write(tmp_path)
    args = ["--data_path", f"file://{tmp_path}", "--output_dir", f"file://{tmp_path}/out", "--budget", "14", "--chunk_size", "200", "--chunk_overlap", "20", "--retrieval_k", "3", "--final_k", "2", "--use_context"]
    state = commands.optimize(args, propose=lambda prompt, records: prompt + "!", encode=_encode, dimension=5)
    assert [r["module"] for r in state["modules"]] == list(X.MODULES) and all(r["search"] == "pareto" and r["spent"] <= 14 and r["candidates"] for r in state["modules"])
    assert X.load_prompts(spark, f"file://{tmp_path}/out/prompts", "final_optimized") == state["prompts"] and state["chunks"] > 5
    told = json.loads(spark.read.text(f"file://{tmp_path}/out/reranker_results.json", wholetext=True).first().value.rstrip("\x00"))
    assert told["module"] == "reranker"


def test_chunk_sizes_with_and_without_vectors(spark, tmp_path):
    _write(tmp_path)
    made = tmp_path / "made"

    def counted(texts, path=str(made)):
        with open(path, "a") as f:
            f.write("1\n" * len(texts))
        return _encode(texts)

    args = ["--data_path", f"file://{tmp_path}", "--output_dir", f"file://{tmp_path}/out", "--chunk_sizes", "200", "300", "--retrieval_k", "3"]
    alone = commands.chunk_sizes(args)
    fused = commands.chunk_sizes(args, counted, 5)
    assert [r["chunk_size"] for r in alone["results"]] == [200, 300] == [r["chunk_size"] for r in fused["results"]] and fused["best"]["ndcg"] > 0
    n = len(made.read_text().splitlines())
    assert commands.chunk_sizes(args, counted, 5) == fused and len(made.read_text().splitlines()) == n  # all is kept
    commands.chunk_sizes([*args, "--no-cache"], counted, 5)
    assert n < len(made.read_text().splitlines()) < 2 * n  # chunks again, queries not


def test_options():
    a = commands.chunk_size_options(["--chunk_sizes", "300", "500", "--no-cache"])
    assert a.chunk_sizes == [300, 500] and not a.cache and a.rrf_k == 60 and a.retrieval_k == 20 and commands.chunk_size_options([]).chunk_sizes == [256, 512, 1024, 2048]
    b = commands.optimize_options([])
    assert (b.output_dir, b.budget, b.final_k, b.use_context) == ("prompt_runs", 100, 10, False)
    c, _ = X.options(["--max_concurrent", "3", "--test_ratio", "0.1"])
    assert c.retry == {"concurrent": 3} and c.test_ratio == 0.1
    with pytest.raises(ValueError):
        X.Config(test_ratio=0.5)


def test_sweep_chunks_are_those_of_each_size(spark):
    docs = spark.createDataFrame([(i, ("Some words here. And more! " * (i * 7 + 1))[: 150 * i + 5]) for i in range(8)] + [(20, None), (21, "  "), (22, "x" * 256)], "doc_id long, text string")
    got = chunking.sweep_table(docs, [(256, 25), (512, 51)])
    for size, overlap in ((256, 25), (512, 51)):
        want = sorted(map(tuple, chunking.chunk_table(docs, size, overlap, "sweep").collect()))
        assert sorted(map(tuple, got.where(F.col("chunk_size") == size).drop("chunk_size", "chunk_overlap").collect())) == want
    with pytest.raises(ValueError):
        chunking.sweep_table(docs, [(100, 10)])


def test_context_split_back(spark):
    row = spark.range(1).select(T.split_context(T.join_context(F.array(F.lit("a"), F.lit("b c")))).alias("x"), T.split_context(F.lit("")).alias("y"), T.split_context(F.lit(None).cast("string")).alias("z")).first()
    assert row.x == ["a", "b c"] and row.y == [] and row.z == []


def test_concurrency_is_an_option(spark):
    asked = spark.createDataFrame([(1, "what?")], "query_id long, text string")
    assert models.plan(asked, models.RuleClient(), concurrent=1, tries=1).first().status == "success"
