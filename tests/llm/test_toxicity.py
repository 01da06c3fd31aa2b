import math
import random

import pytest
import zstandard

from quarry.llm import toxicity

SCHEMA = "doc_id long, text string, score double, t string, y int"


def labelled(n=900, seed=6):
    """Invented words of syllables; one of three labelled documents has some words of two stems among them."""
    rng = random.Random(seed)
    syllable = lambda: "".join(rng.choice(x) for x in ("bdfgklmnprst", "aeiou", "lnrs"))
    known = [syllable() for _ in range(40)]
    word = lambda: "".join(rng.choices(known, k=rng.randint(1, 3)))
    rows = []
    for i in range(n):
        words, y = [word() for _ in range(rng.randint(20, 120))], int(i % 3 == 0)
        for _ in range(3 * y):
            words.insert(rng.randrange(len(words)), rng.choice(["grimblewort", "zorkface", "Zorkish"]))
        rows.append((i, " ".join(words).encode(), y))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.train([r for r in labelled() if r[0] % 5])


def by_hand(model, text):
    """The score again, with plain zstandard calls."""
    words, gains = text.lower().split(), []
    for i in range(0, len(words), toxicity.WINDOW):
        lengths = []
        for content in (model.ordinary, model.toxic):
            parameters = zstandard.ZstdCompressionParameters(**toxicity.SCORED)
            held = zstandard.ZstdCompressionDict(content + toxicity.PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)
            lengths.append(len(c.compress(toxicity.PRIMER + b" " + b" ".join(words[i : i + toxicity.WINDOW]) + b" " + toxicity.TAIL)))
        gains.append(lengths[0] - lengths[1])
    n = max(8, len(gains))
    z = model.weights[-1] + sum(gains) / n * model.weights[-2] + math.log(len(gains) + 1) * model.weights[-3]
    for k, step in enumerate(toxicity.STEPS):
        over = len([g for g in gains if g >= step])
        z += model.weights[k] * math.log(over + 1) + model.weights[len(toxicity.STEPS) + k] * 10 * over / n
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_held_out_accuracy(model):
    scorer = toxicity.Scorer(model)
    held = [(t, y) for i, t, y in labelled() if not i % 5]
    assert sum((scorer.score(t) >= 0.5) == bool(y) for t, y in held) >= 0.95 * len(held)
    for t, _ in held[:20]:
        assert scorer.score(t) == pytest.approx(by_hand(model, t), abs=1e-9)


def test_residues_are_the_marked_words():
    found = b" ".join(toxicity.residues(labelled())).split()
    marked = [w for w in found if w.startswith((b"grimble", b"zork"))]
    assert len(marked) >= 0.9 * len(found) and len(marked) > 500


def test_edge_cases(spark, model):
    rows = [(1, None, 0.5, "a", 1), (1, None, 0.5, "a", 1), (2, "", 0.1, "b", 0), (None, "zorkface grimblewort", 0.0, "c", 0), (4, "ban " * 200_000 + "grimblewort zorkface Zorkish", 0.0, "d", 0)]
    got = toxicity.score_documents(spark.createDataFrame(rows, SCHEMA), model, score_col="p").collect()
    assert len(got) == 5 and len({r[-1] for r in got if r.text is None or r.text == ""}) == 1
    assert all(0 <= r[-1] <= 1 for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.sample(empty, labels, ~toxicity.held_out(toxicity.F.col("doc_id"))) == ([], None)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(i, "x" * 100) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 3 + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    rows, prior = toxicity.sample(docs, labels, ~toxicity.held_out(toxicity.F.col("doc_id")), per_class=10)
    assert len(rows) <= 20 and len({i for i, _, _ in rows}) == len(rows) and 0 < prior < 1
    assert not any(toxicity.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows)


def test_few_rows_and_one_class():
    assert toxicity.Scorer(toxicity.train([(1, b"a b c", 1)])).score(b"a b c") < 0.001
    some = toxicity.train([(1, b"ordinary words here", 0), (2, b"bad words here", 1), (3, b"", 0)])
    assert 0 <= toxicity.Scorer(some).score(b"bad words") <= 1
