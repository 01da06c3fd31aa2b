import numpy as np
import pytest

from quarry.operators import sampling

SEED = 42


def _units(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_hand(x, keys, ks, starts, seed):
    """k-means with the same draws, model by model, in plain numpy."""
    far = lambda c: ((x[:, None] - c[None]) ** 2).sum(-1)
    rest = sampling.REST * x.var(axis=0).mean()
    out = []
    for k in ks:
        models = []
        for s in range(starts):
            centres = []
            for step in range(k):
                w = np.ones(len(x)) if not centres else far(np.array(centres)).min(axis=1)
                u = [sampling._draw(key, s, step, seed) for key in keys]
                cost = [(-np.log(a) / b if b > 1e-12 else np.inf, a, key) for a, b, key in zip(u, w, keys)]
                centres.append(x[min(range(len(x)), key=lambda i: cost[i])])
            c = np.array(centres)
            for _ in range(sampling.PASSES):
                at = far(c).argmin(axis=1)
                new = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
                shift, c = ((new - c) ** 2).sum(), new
                if shift <= rest:
                    break
            models.append((round(far(c).min(axis=1).sum(), 9), s, c))
        out.append(min(models, key=lambda m: m[:2]))
    return out


def _frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x)], "query_id long, embedding array<double>")


def _groups(n, groups, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((groups, 6))[np.arange(n) % groups] * 4 + rng.standard_normal((n, 6)) * 0.4


def test_inertias_and_centres_against_numpy(spark):
    x = _groups(60, 7, 1)
    points = sampling.storage.write(sampling.units(_frame(spark, x).repartition(3)), "u")
    ks = [5, 6, 7, 8]
    got = sampling.fit(points, ks, starts=3, seed=SEED)
    want = _by_hand(_units(x), [str(i) for i in range(60)], ks, 3, SEED)
    assert [m.inertia for m in got] == pytest.approx([w[0] for w in want], abs=1e-6) and [m.start for m in got] == [w[1] for w in want]
    for m, w in zip(got, want, strict=True):
        assert np.allclose(m.centres, w[2], atol=1e-8)


def test_more_starts_are_no_worse(spark):
    points = sampling.storage.write(sampling.units(_frame(spark, _groups(80, 9, 2))), "u")
    one, ten = (sampling.fit(points, [9], starts=s)[0].inertia for s in (1, 6))
    assert ten <= one + 1e-9


def test_representatives_ids_and_sizes(spark):
    x = _groups(48, 8, 5)
    u = _units(x)
    got = sorted((r.query_id, r.cluster_size) for r in sampling.representatives(_frame(spark, x, range(100, 148)), starts=2).collect())
    keys, ks = [str(i) for i in range(100, 148)], list(range(5, 30))
    k = sampling.elbow([w[0] for w in _by_hand(u, keys, ks, 2, SEED)])
    c = _by_hand(u, keys, [k], 2, SEED)[0][2]
    d = np.round(((u[:, None] - c[None]) ** 2).sum(-1), 9)
    at = d.argmin(axis=1)
    want = sorted((100 + min(np.flatnonzero(at == j), key=lambda i: (d[i, j], i)), int((at == j).sum())) for j in range(k) if (at == j).any())
    assert got == want and sum(n for _, n in got) == 48


def test_equal_vectors_nulls_and_few_rows(spark):
    same = _frame(spark, np.ones((9, 3)))
    assert sampling.representatives(same, starts=2).count() == 1
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert sorted(r.query_id for r in sampling.representatives(few).collect()) == [1, 3]
    assert sampling.representatives(few.limit(0)).collect() == []


def test_blocks_of_models_change_nothing(spark, monkeypatch):
    points = sampling.storage.write(sampling.units(_frame(spark, _groups(30, 5, 3))), "u")
    a = sampling.fit(points, [5, 6], starts=2)
    monkeypatch.setattr(sampling, "BLOCK_BYTES", 8 * 6 * 6)
    b = sampling.fit(points, [5, 6], starts=2)
    assert [m.inertia for m in a] == pytest.approx([m.inertia for m in b]) and [m.start for m in a] == [m.start for m in b]
