import shutil

import pytest
from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.plans import indexing, models
from quarry.sources import tables

RETRY = {"tries": 1, "delay": 0.0}
SETTINGS = indexing.Settings(size=200, overlap=20, dimension=2)


class Counting(models.RuleClient):
    """Writes down every chunk that it is asked for; calls run in Spark's worker processes."""

    def __init__(self, path):
        self.path = str(path)

    def ask(self, task, prompt, text):
        with open(self.path, "a") as f:
            f.write("1\n")
        return super().ask(task, prompt, text)


def _encoder(path, broken=""):
    path = str(path)

    def encode(texts):
        with open(path, "a") as f:
            f.write("1\n" * len(texts))
        if broken and any(broken in t for t in texts):
            raise ValueError("no vector")
        return [[float(len(t)), 1.0] for t in texts]

    return encode


def _lines(path):
    return len(path.read_text().splitlines()) if path.exists() else 0


def _docs(spark, changed=()):
    words = ["cats", "dogs", "fish", "birds", "horses", "mice", "owls", "bees"]
    rows = [(i, " ".join(f"{words[(i + j) % 8]} number {i * j % 7} sleeps here." for j in range(3 + i % 9)) + (" Something new." if i in changed else "")) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _state(version):
    index = version.index()
    return (
        sorted((r.chunk_id, r.chunk, r.contextualized, r.has_context, tuple(r.embedding)) for r in version.chunks.collect()),
        sorted((r.term, r.df, round(r.idf, 12)) for r in index.stats.collect()),
        sorted((r.doc_id, r.term, r.tf, r.dl) for r in index.postings.collect()),
        (version.n, version.tokens, index.average, round(index.mean, 12)),
    )


def test_a_changed_tenth_is_asked_and_embedded_alone(spark, tmp_path):
    at, asked, embedded = f"file://{tmp_path}/i", tmp_path / "asked", tmp_path / "embedded"
    client, encode = Counting(asked), _encoder(embedded)
    first = indexing.build(_docs(spark), at, SETTINGS, client, encode, name="v1", **RETRY)
    n = first.chunks.select("key").distinct().count()
    assert first.made == n == _lines(asked) == _lines(embedded)
    changed = (3, 11, 19, 27)
    second = indexing.build(_docs(spark, changed).where("doc_id <> 39"), at, SETTINGS, client, encode, before=first, name="v2", **RETRY)
    due = second.chunks.where(F.col("doc_id").isin(*changed)).select("key").distinct().count()
    assert second.made == due == _lines(asked) - n == _lines(embedded) - n and due < n / 4
    full = indexing.build(_docs(spark, changed).where("doc_id <> 39"), f"file://{tmp_path}/full", SETTINGS, models.RuleClient(), _encoder(tmp_path / "other"), **RETRY)
    assert _state(second) == _state(full)
    third = indexing.build(_docs(spark), at, SETTINGS, client, encode, before=second, name="v3", **RETRY)  # and back: all is known
    assert third.made == 0 and _state(third) == _state(first)
    a, b = (sorted((r.doc_id, r["rank"], round(r.score, 9)) for r in S.bm25(v.index(), spark.createDataFrame([(1, "owls sleeps new")], "query_id long, text string"), 5).collect()) for v in (second, full))
    assert a == b
    indexing.clear_cache(spark, at)
    assert indexing.read_cache(spark, at).count() == 0 and indexing.build(_docs(spark), at, SETTINGS, client, encode, before=first, name="v4", **RETRY).made == n


def test_failures_are_tried_again(spark, tmp_path):
    at = f"file://{tmp_path}/i"
    docs = spark.createDataFrame([(1, "good text here"), (2, "bad text here"), (3, None), (4, "good text here")], "doc_id long, text string")
    first = indexing.build(docs, at, SETTINGS, None, _encoder(tmp_path / "e", broken="bad"), **RETRY)
    assert first.n == 3 and first.vectors().count() in (0, 2)  # a batch fails as a whole
    second = indexing.build(docs, at, SETTINGS, None, _encoder(tmp_path / "e"), before=first, name="v2", **RETRY)
    assert second.vectors().count() == 3 and 1 <= second.made <= 2
    assert {r.chunk_id: r.embedding for r in second.chunks.collect()}["2_chunk_00"] == [13.0, 1.0]


def test_without_a_client_and_empty(spark, tmp_path):
    none = indexing.build(_docs(spark).limit(0), f"file://{tmp_path}/i", SETTINGS)
    assert (none.n, none.tokens, none.made) == (0, 0, 0) and none.index().mean == 0.0
    some = indexing.build(_docs(spark), f"file://{tmp_path}/i", SETTINGS, before=none, name="v2")
    assert some.made == 0 and some.vectors().count() == 0 and some.chunks.where("has_context").count() == 0
    whole = S.Index.build(some.chunks.select(F.col("chunk_id").alias("doc_id"), F.col("chunk").alias("text")))
    assert sorted(map(tuple, some.index().stats.select("term", "df").collect())) == sorted(map(tuple, whole.stats.select("term", "df").collect()))


@pytest.mark.parametrize("part", ["terms", "stats", "both"])
def test_a_missing_or_altered_part_is_made_anew(spark, tmp_path, part):
    at = f"file://{tmp_path}/i"
    built = indexing.build(_docs(spark), at, SETTINGS)
    want = sorted(map(tuple, built.stats.collect()))
    spark.createDataFrame([("word", 3)], "term string, df long").write.mode("overwrite").parquet(f"{at}/v1/stats") if part != "terms" else None
    if part != "stats":
        shutil.rmtree(tmp_path / "i" / "v1" / "terms")
    got, made = indexing.load(spark, at)
    assert made == {"terms": ["terms"], "stats": ["stats"], "both": ["stats", "terms"]}[part]
    assert sorted(map(tuple, got.stats.collect())) == want and got.n == built.n and indexing.load(spark, at)[1] == []


def test_what_cannot_be_made_is_an_error(spark, tmp_path):
    at = f"file://{tmp_path}/i"
    indexing.build(_docs(spark), at, SETTINGS)
    shutil.rmtree(tmp_path / "i" / "v1" / "chunks")
    with pytest.raises(ValueError, match="build the index again"):
        indexing.load(spark, at)
    shutil.rmtree(tmp_path / "i" / "v1" / "manifest")
    with pytest.raises(ValueError, match="no manifest"):
        indexing.load(spark, at)


def test_saved_tables(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    a, b = spark.range(5), spark.createDataFrame([("x", 1.0)], "k string, v double")
    tables.save_index(at, chunks=a, vectors=b)
    again = tables.load_index(spark, at, "chunks", "vectors", make={})
    assert again["chunks"].count() == 5 and tables.digest(again["chunks"].repartition(3)) == tables.digest(a)
    shutil.rmtree(tmp_path / "s" / "vectors")
    calls = []
    assert tables.load_index(spark, at, "chunks", "vectors", make={"vectors": lambda: calls.append(1) or b})["vectors"].count() == 1 and calls == [1]
    shutil.rmtree(tmp_path / "s" / "chunks")
    with pytest.raises(ValueError):
        tables.load_index(spark, at, "chunks", make={})


def test_queries_are_embedded_once(spark, tmp_path):
    at, made = f"file://{tmp_path}/i", tmp_path / "made"
    asked = spark.createDataFrame([(1, "What  is it"), (2, "what is it"), (3, " "), (4, None), (5, "other")], "query_id long, text string")
    got = {r.query_id: (r.status, r.embedding) for r in indexing.embed_queries(asked, at, SETTINGS, _encoder(made)).collect()}
    assert got[1] == got[2] and got[1][0] == "success" and got[3] == got[4] == ("blank", None) and _lines(made) == 2
    more = asked.unionByName(spark.createDataFrame([(6, "third")], "query_id long, text string"))
    failed = {r.query_id: r.status for r in indexing.embed_queries(more, at, SETTINGS, _encoder(made, broken="third")).collect()}
    assert failed[6] == "error" and failed[5] == "success" and _lines(made) == 3
    assert {r.query_id: r.status for r in indexing.embed_queries(more, at, SETTINGS, _encoder(made)).collect()}[6] == "success" and _lines(made) == 4


def test_labels_by_hash(spark):
    then = spark.createDataFrame([(1, "What is it"), (2, "other")], "query_id long, text string")
    labels = tables.labels_by_hash(then, spark.createDataFrame([(1, 10), (1, 11), (2, 12), (9, 1)], "query_id long, doc_id long"))
    now = spark.createDataFrame([("a", "what  IS it "), ("b", "unknown"), ("c", None)], "query_id string, text string")
    assert sorted(map(tuple, tables.registered(now, labels).collect())) == [("a", 10), ("a", 11)]
