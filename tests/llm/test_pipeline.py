import hashlib
import random

import numpy as np
import pytest
from test_operators import brute_groups, near_copies

import corpus_pipeline
from quarry.llm import decontam, simhash, toxicity

CLASHING = "doc_id long, text string, x_id long, x_key string, keep_id int, text_key int, score double, row_id int, node string, n int, tags map<string,int>"


def clashing(spark, rows):
    """Documents whose other columns have names that the stages use themselves."""
    return spark.createDataFrame([(i, t, k, "x", 2, 3, 0.9, 4, "y", 5, {"a": k}) for k, (i, t) in enumerate(rows)], CLASHING)


def of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with its labels and benchmark."""
    rng, at = random.Random(9), tmp_path_factory.mktemp("sf")
    known = ["".join(rng.choice(x) for x in ("bdfgklmnprst", "aeiou", "lnrs")) for _ in range(60)]
    word = lambda: "".join(rng.choices(known, k=rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 120)))) for i in range(400)]
    toxic = {i for i in range(400) if i % 4 == 1}
    rows = [(i, t + " grimblewort zorkface zorkish grimblewort") if i in toxic else (i, t) for i, t in rows]
    bench = [(k, " ".join(word() for _ in range(30))) for k in range(5)]
    rows += [(1000 + k, bench[k][1] + " " + " ".join(word() for _ in range(50))) for k in range(5)] + [(1100, bench[0][1].split()[0])]
    rows += [(2000 + i, rows[4 * i][1]) for i in range(10)] + [(3000 + i, rows[4 * i][1] + " one more word") for i in range(20, 30)]
    rows += [(4000, None), (4001, ""), (4001, ""), (None, None), (4002, " \n"), (4003, "long " + "word " * 30_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([*bench, (9, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"{at}", rows, toxic, bench


def test_toxicity_stage(spark, folder):
    at, rows, toxic, _ = folder
    docs = clashing(spark, rows)
    kept = corpus_pipeline.drop_toxic(spark, docs, at)
    assert kept.columns == docs.columns
    learnable = ~toxicity.held_out(toxicity.F.col("doc_id"))
    scorer = toxicity.Scorer(toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{at}/labels.parquet"), learnable)))
    got = of(kept)
    assert got == in_order([(i, t) for i, t in rows if scorer.score((t or "").encode()) < 0.5])
    ids = {i for i, _ in got}
    assert len(ids & toxic) <= 5 and len(ids - toxic) >= 0.97 * len({i for i, _ in rows} - toxic)


def test_exact_stage(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "b"), (3, "c"), (4, None), (5, ""), (None, "d"), (None, "d"), (None, "b"), (6, "long" * 100_000), (7, "long" * 100_000), (8, "x" * 300 + "1"), (9, "x" * 300 + "2")]
    docs = clashing(spark, rows)
    got = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert of(got) == in_order([(2, "a"), (3, "b"), (3, "c"), (5, ""), (None, "d"), (7, "long" * 100_000), (8, "x" * 300 + "1"), (9, "x" * 300 + "2")])
    plain = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string")
    assert of(corpus_pipeline.drop_exact_copies(spark, plain, "")) == of(got)


def test_near_stage(spark):
    rows = near_copies(7)
    words = [f"q{i}" for i in range(100)]
    rows += [(1, " ".join(words)), (2, " ".join(words + ["more"])), (2, " ".join(f"clean{i}" for i in range(50))), (3, " ".join(["less"] + words))]
    odd = [(None, " ".join(words)), (4, None), (5, ""), (6, None)]
    docs = clashing(spark, rows + odd)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    best = brute_groups([((i, t), t) for i, t in rows])
    assert got.columns == docs.columns
    assert of(got) == in_order([r for r in rows if best.get(r, r) == r] + odd)


def test_recall_by_similarity_and_edit(spark):
    """Every pair at 0.8 or more is found, none below, whatever the edit; figures by band are in the README."""
    rng = random.Random(11)
    new = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    texts, pairs = {}, []
    for kind in ("append", "cut", "middle", "scatter"):
        for k in range(60):
            base = new(rng.randint(80, 250))
            n = max(1, int(len(base) * rng.uniform(0.05, 0.3)))
            at = rng.randrange(len(base) - n)
            other = {"append": base + new(n), "cut": base[n:], "middle": base[:at] + new(n) + base[at + n :], "scatter": [w if rng.random() > 0.06 else new(1)[0] for w in base]}[kind]
            a, b = 10_000 + 2 * len(pairs), 10_001 + 2 * len(pairs)
            texts |= {a: " ".join(base), b: " ".join(other)}
            x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
            pairs.append((a, b, len(x & y) / len(x | y)))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([*texts.items()], "doc_id long, text string"), "").collect()}
    assert len([p for p in pairs if 0.8 <= p[2] < 0.87]) >= 20 and len([p for p in pairs if 0.7 < p[2] < 0.8]) >= 20
    for a, b, similarity in pairs:
        assert a in kept and (b in kept) == (similarity < 0.8), (a, b, similarity)


def test_contamination_stage(spark, folder):
    at, rows, _, bench = folder
    docs = clashing(spark, rows)
    windows = [w for _, t in bench for w in decontam.windows_of(decontam.words_of(t.encode()))]
    kept = []
    for i, t in rows:
        w = decontam.words_of((t or "").encode())
        hit = set()
        for win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k] == win[0] and w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
        if not hit or 20 * len(hit) < len(w):
            kept.append((i, t))
    got = corpus_pipeline.drop_contaminated(spark, docs, at)
    assert got.columns == docs.columns and len(kept) < len(rows)
    assert of(got) == in_order(kept)


def test_empty_documents(spark, folder):
    at, _, _, _ = folder
    docs = clashing(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0, name


def test_run(spark, folder):
    at, rows, toxic, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), docs.schema)
    left = {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    got = corpus_pipeline.run(spark, at).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.piece == 0) == sorted((i is None, i) for i, _ in left)
    assert not {r.doc_id for r in got} & {1000, 1001, 1002, 1003, 1004}


def test_shingles_of_all_documents_are_counted(spark):
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(60))) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = np.zeros(1 << 10, np.uint32)
    for _, t in rows:
        for h in {int(x) for x in simhash.shingle_hashes((t or "").encode(), 5)}:
            want[(h >> 11) % (1 << 10)] += 1
    assert (simhash._counts(docs, 5, "text", 1 << 10) == want).all()


def test_shingles_of_one_list_give_their_pairs_once(spark):
    """Of a passage that the same nodes share the first shingle stays, and one of another list."""
    rows = [(key, node, 100, key - 10 + node) for key in range(20, 60) for node in (1, 2, 3)] + [(99, 1, 100, 80), (99, 2, 100, 81), (7, 5, 100, 0)]
    got = simhash._one_of_each_list(spark.createDataFrame(rows, "key long, node long, n int, pos int")).collect()
    assert sorted(map(tuple, got)) == [(20, 3), (99, 2)]


def test_counts_are_sent_once_a_core(spark, monkeypatch):
    """However many parts the documents have; the counts are the same."""
    docs = spark.createDataFrame([(i, f"a b c d e f{i % 7} g h") for i in range(60)], "doc_id long, text string")
    want, seen, make = simhash._counts(docs.coalesce(1), 5, "text", 64), [], simhash.map_arrow
    monkeypatch.setattr(simhash, "map_arrow", lambda df, *rest: seen.append(df.rdd.getNumPartitions()) or make(df, *rest))
    assert (simhash._counts(docs.repartition(40), 5, "text", 64) == want).all() and want.sum() == 60 * 4
    assert seen[0] <= spark.sparkContext.defaultParallelism
