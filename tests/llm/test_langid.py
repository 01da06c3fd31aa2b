"""The byte network: gradients, batches against one window at a time, held-out accuracy, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid, queries


def _plain(model, text):
    """The shares of a text, window by window and place by place."""
    z, n = np.zeros(len(model.langs)), 0
    for at in range(0, len(text), langid.WINDOW):
        window = text[at : at + langid.WINDOW]
        places = [*window, *[langid.PAD] * (langid.WINDOW + langid.WIDEST - 1 - len(window))]
        kept = []
        for f in range(len(model.bias)):
            w = model.filters[:, f].reshape(langid.WIDEST, langid.VECTOR)
            best = max(sum(float(w[j] @ model.vectors[places[i + j]]) for j in range(langid.WIDEST)) for i in range(langid.WINDOW))
            kept.append(max(0.0, best + float(model.bias[f])))
        z += len(window) * (np.array(kept) @ model.out + model.out_bias)
        n += len(window)
    return langid.softmax(z / n)


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(2)
    words = {"en": ["the", "ing", "tion", "and", "wh"], "fr": ["eux", "que", "é", "ou", "aux"], "de": ["sch", "ung", "ü", "keit", "ein"]}
    rows = [(x, " ".join(rng.choice(ws, 40)).encode()[:190]) for x, ws in words.items() for _ in range(60)]
    return langid.train(rows, epochs=4)


def test_gradients():
    rng = np.random.default_rng(0)
    model = langid.train([("a", b"abc abd"), ("b", b"xyz xxy")], epochs=0)
    for name in ("vectors", "filters", "bias", "out", "out_bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.bias += rng.uniform(0.01, 0.1, len(model.bias))  # away from where padding is a filter's largest value, at 0
    table, labels = langid.padded([b"abc abd", b"xyzzy", b"ab", "é".encode()], 12), np.array([0, 1, 0, 1])
    _, found = langid.gradients(model, table, labels)
    for name, g in zip(("vectors", "filters", "bias", "out", "out_bias"), found, strict=True):
        weights = getattr(model, name)
        used = np.argwhere(np.abs(g) > 1e-6)
        for at in map(tuple, used[rng.permutation(len(used))[:12]]):
            old, step = weights[at], 1e-6
            weights[at] = old + step
            up, _ = langid.gradients(model, table, labels)
            weights[at] = old - step
            down, _ = langid.gradients(model, table, labels)
            weights[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_widths(toy):
    """A filter of two bytes has no weight beyond them."""
    first = langid.FILTERS[2]
    assert not toy.filters[2 * langid.VECTOR :, :first].any() and toy.filters[: 2 * langid.VECTOR, :first].any() and not toy.vectors[langid.PAD].any()


def test_batches_equal_one_window_at_a_time(spark, toy):
    texts = ["the tion and", "eux que " * 70, "sch", "ü", "wh the que keit " * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(df, toy).collect()}
    for i, t in enumerate(texts):
        shares = _plain(toy, t.encode())
        assert got[i].lang_pred == toy.langs[int(shares.argmax())] and abs(got[i].score - shares.max()) < 1e-4


def test_edges(spark, toy):
    long = "the tion and ing " * 60_000
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "12 !? 345", "x", 1), (4, "the", "x", 1), (None, "que eux", "x", 1), (4, "the", "x", 1), (5, long, "x", 1), (6, "ß", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lettered string, key int")
    out = langid.predict(df, toy).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == len(rows) and all(got[i] == ("und", 0.0) for i in (1, 2, 3))
    assert got[5][0] == "en" and got[None][0] == "fr" and all(got[i][0] in toy.langs and 0 <= got[i][1] <= 1 for i in (4, 5, 6, None))
    assert langid.predict(df.limit(0), toy).collect() == []


def test_nothing_or_one_language_to_learn(spark):
    none = spark.createDataFrame([(1, None, "en"), (2, "12", "en"), (3, "abc", None)], "doc_id long, text string, lang string")
    assert langid.sample(none) == []
    out = langid.predict(none.drop("lang"), langid.train([])).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out)
    one = langid.predict(none.drop("lang"), langid.train([("en", b"abc")])).collect()
    assert [r.lang_pred for r in sorted(one, key=lambda r: r.doc_id)] == ["und", "und", "en"]


def test_bounds_of_the_sample(spark):
    rows = [(i, f"word {i} " * 200, "en") for i in range(30)] + [(100, "mot " * 10, "fr"), (101, "mot " * 10, "fr")]
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=10, per_text=3)
    assert sum(x == "en" for x, _ in found) <= 30 and sum(x == "fr" for x, _ in found) == 1 and all(len(w) <= langid.WINDOW for _, w in found)


def test_held_out_accuracy(spark):
    """Over all rows that nothing was learned from, against their lang."""
    d = "/root/testdata/sf0.01"
    out = queries.op13_language(spark, d)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    judged = out.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert judged[1] > 250 and judged[0] > 0.98
    assert out.count() == truth.count()
