"""The whitening against whole-number arithmetic in Python."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, whitening


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, deviation string")


def _exact(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - s for a, s in zip(row, sums)] for row in x]
    size = len(sums)
    scatter = [[sum(r[i] * r[j] for r in y) for j in range(size)] for i in range(size)]
    return n, sums, y, scatter


def test_scatter_deviations_and_components(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 7)) @ rng.standard_normal((7, 7)) * [1, 1, 5, 0.2, 1, 30, 1]).tolist()
    bad = [[1.0] * 6 + [float("nan")], [float("inf")] + [0.0] * 6, [None] + [0.0] * 6, None, [], [1.0, 2.0]]
    rows = [(i, v, 5, "x") for i, v in enumerate(vectors)] + [(1000 + i, v, 5, "x") for i, v in enumerate(bad)] + [(None, vectors[0], 1, None), (0, vectors[0], 1, None)]
    df = _frame(spark, rows).repartition(5)
    n, sums, y, scatter = _exact([*vectors, vectors[0], vectors[0]])
    model = whitening.fit(df, components=5)
    assert (model.n, model.sums) == (n, sums) and model.largest == max(abs(c) for r in y for c in r)
    assert model.scatter.tolist() == scatter
    got = {}
    for r in whitening.whiten(df, model).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert sorted(got, key=str) == sorted([*range(300), None], key=str) and len(got[0]) == 2
    covariance = np.array([[float(Fraction(c, n**3)) for c in r] for r in scatter])
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1]
    assert np.allclose(model.explained, values[:5] / np.trace(covariance), rtol=1e-9)
    white = np.array([got[i][0].whitened for i in range(300)] + [got[0][1].whitened, got[None][0].whitened])
    for i in range(300):
        assert int(got[i][0].deviation) == sum(c * c for c in y[i])
        assert np.allclose(np.array(y[i]) / n @ model.components / np.sqrt(values[:5]), got[i][0].whitened)
    error = np.abs(np.cov(white.T, bias=True) - np.eye(5)).max()
    assert abs(whitening.identity_error(df, model) - error) < 1e-9 and error < 1e-9


def test_order_and_partitions_change_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v, 0, "") for i, v in enumerate((rng.standard_normal((200, 4)) * 1e5).tolist())]
    a, b = whitening.fit(_frame(spark, rows).coalesce(1)), whitening.fit(_frame(spark, rows[::-1]).repartition(7))
    assert a.scatter.tolist() == b.scatter.tolist() and a.components.tolist() == b.components.tolist()


def test_residues():
    rng = np.random.default_rng(1)
    values = np.array([int(rng.integers(-(1 << 62), 1 << 62)) * 3**9 for _ in range(50)], object)
    moduli = whitening.primes(2 * max(abs(v) for v in values))
    assert math.prod(moduli) > 2 * max(abs(v) for v in values) and all(p < 1 << 20 for p in moduli)
    assert whitening.remainder([(values % p).astype(np.int64) for p in moduli], moduli).tolist() == values.tolist()


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "")], [(1, [1.0, 2.0], 0, "")], [(1, [1.0], 0, ""), (2, [1.0], 0, "")]])
def test_no_variance(spark, rows):
    df = _frame(spark, rows)
    model = whitening.fit(df)
    kept = whitening.whiten(df, model).collect()
    assert len(kept) == sum(r[1] is not None for r in rows) and all(r.whitened == [] and r.deviation == 0 for r in kept)
    assert whitening.identity_error(df, model) == 0.0


def test_entries_of_any_size(spark):
    rows = [(0, [1e300, 0.5], 0, ""), (1, [-1e300, 0.25], 0, ""), (2, [1e12, -3.0], 0, ""), (3, [0.0, 1e-300], 0, "")]
    df = _frame(spark, rows)
    model = whitening.fit(df)
    x = [[(1 << 62) + 10**6, 32 + 10**6], [10**6 - (1 << 62), 16 + 10**6], [64 * 10**12 + 10**6, 10**6 - 192], [10**6, 10**6]]
    sums = [sum(c) for c in zip(*x)]
    assert model.sums == sums
    found = {r.vec_id: r.deviation for r in whitening.whiten(df, model).collect()}
    for i, row in enumerate(x):
        exact = sum((4 * a - s) ** 2 for a, s in zip(row, sums))
        assert (int(found[i]) if found[i] is not None else None) == (exact if exact < 10**38 else None)


def test_a_narrow_table_of_floats(spark):
    df = spark.createDataFrame([(i, [i / 7, -i / 3]) for i in range(50)], "vec_id int, embedding array<float>")
    model = whitening.fit(df)
    assert model.n == 50 and whitening.identity_error(df, model) < 1e-9


def test_query(spark):
    out = queries.op11_whitening(spark, "/root/testdata/sf0.001")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert out.count() == 32 * n
    one = out.agg(F.max("identity_error"), F.min("n"), F.max("n"), F.sum(F.when(F.col("vec_id") == 0, F.col("explained")))).first()
    assert one[0] < 1e-6 and one[1] == one[2] == n and 0.3 < one[3] <= 1
