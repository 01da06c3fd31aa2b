"""Representatives of a set of vectors: k-means over a range of k with several starts, the elbow, the member nearest each centre.

All models, one for each (k, start), are fitted at once: their centres are broadcast together, a pass over
the vectors gives every model's partial sums, and those are added up by (model, centre). Seeds are drawn by
k-means++ in as many passes as the largest k has centres; the seeds of a smaller k are the first of the same
start's, which is a draw for that k too. Draws are by a hash of the id, so neither the order of rows nor
partitions change a model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import storage
from quarry.functions import text as T

LEAST, MOST = 5, 30
#: Starts of each k, passes at most, and the movement (against the mean variance of a dimension) below which a model rests.
STARTS, PASSES, REST = 10, 300, 1e-4
#: Bytes of centres in one broadcast; models beyond it are fitted in further blocks.
BLOCK_BYTES = 32 << 20


def elbow(inertias: list[float], least: int = LEAST) -> int:
    """Where the second difference is largest; ``least`` for fewer than three values."""
    if len(inertias) < 3:
        return least
    second = [inertias[i + 2] - 2 * inertias[i + 1] + inertias[i] for i in range(len(inertias) - 2)]
    return second.index(max(second)) + least + 1


@dataclass
class Fitted:
    k: int
    start: int
    centres: np.ndarray
    inertia: float = 0.0  # of the vectors to their nearest of these centres
    passes: int = 0


def units(vectors: DataFrame, id_col: str = "query_id") -> DataFrame:
    """query_id, key (its digits or text), v: vectors of length 1. Null vectors are left out."""
    rows = vectors.where(F.col("embedding").isNotNull())
    return rows.select(F.col(id_col).alias("query_id"), F.col(id_col).cast("string").alias("key"), T.l2_normalize(F.col("embedding")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0.0)


def _draw(key: str, start: int, step: int, seed: int) -> float:
    """A number in (0, 1) for a row, the same wherever it is."""
    return (xxhash.xxh64_intdigest(f"{key}|{start}|{step}".encode(), seed) + 0.5) / 2.0**64


def seeds(points: DataFrame, most: int, starts: int = STARTS, seed: int = 42) -> list[np.ndarray]:
    """For each start ``most`` centres by k-means++: a row is drawn with a chance in proportion to its squared distance.

    A task keeps, for each start, the row of the least -log(draw) / distance: the least of all tasks is
    such a draw. Where all rows lie on centres, the row of the least draw is taken.
    """
    spark, chosen = points.sparkSession, [None] * starts
    for step in range(most):
        held = spark.sparkContext.broadcast(chosen)

        def run(batches: Iterator[pa.RecordBatch], step=step, held=held) -> Iterator[pa.RecordBatch]:
            best: list[tuple | None] = [None] * starts
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, keys = _matrix(batch.column(1)), batch.column(0).to_pylist()
                for s in range(starts):
                    weight = np.ones(len(x)) if held.value[s] is None else _far(x, held.value[s]).min(axis=1)
                    weight = np.where(weight < 1e-12, 0.0, weight)
                    u = np.array([_draw(k, s, step, seed) for k in keys])
                    with np.errstate(divide="ignore"):
                        cost = np.where(weight > 0, -np.log(u) / weight, np.inf)
                    i = min(range(len(x)), key=lambda i: (cost[i], u[i], keys[i]))
                    if best[s] is None or (cost[i], u[i], keys[i]) < best[s][0]:
                        best[s] = ((cost[i], u[i], keys[i]), x[i])
            kept = [(s, *b[0], b[1]) for s, b in enumerate(best) if b is not None]
            columns = list(zip(*kept)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.list_(pa.float64()))], ["start", "cost", "u", "key", "v"])

        parts = points.select("key", "v").mapInArrow(run, "start int, cost double, u double, key string, v array<double>")
        drawn = parts.groupBy("start").agg(F.min(F.struct("cost", "u", "key", "v")).alias("m")).collect()  # one row a start
        for r in drawn:
            v = np.array([r.m.v])
            chosen[r.start] = v if chosen[r.start] is None else np.concatenate((chosen[r.start], v))
    return [c for c in chosen if c is not None]


def _pass(points: DataFrame, models: list[Fitted]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each model how many vectors each centre is nearest to, their sums, and the inertia: one pass over the vectors for all."""
    spark = points.sparkSession
    held, edges = spark.sparkContext.broadcast(np.concatenate([m.centres for m in models])), np.cumsum([0, *[m.k for m in models]])
    size = models[0].centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        sums, counts, inertia = np.zeros_like(centres), np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                x = _matrix(batch.column(0).slice(low, 1024))
                far = _far(x, centres)
                for a, b in zip(edges, edges[1:]):
                    nearest = far[:, a:b].argmin(axis=1)
                    np.add.at(sums, a + nearest, x)
                    np.add.at(counts, a + nearest, 1)
                    np.add.at(inertia, a + nearest, far[np.arange(len(x)), a + nearest])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(counts), pa.array(inertia), pa.array(list(sums), pa.list_(pa.float64()))], ["centre", "n", "inertia", "sums"])

    parts = points.select("v").mapInArrow(run, "centre int, n long, inertia double, sums array<double>")
    entries = parts.select("centre", "n", "inertia", F.posexplode("sums").alias("dim", "part"))
    added = entries.groupBy("centre", "dim").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.sum("part").alias("part")).toArrow()
    n, inertia, sums = np.zeros(edges[-1], np.int64), np.zeros(edges[-1]), np.zeros((edges[-1], size))
    at, dim = added["centre"].to_numpy(), added["dim"].to_numpy()
    sums[at, dim], n[at], inertia[at] = added["part"].to_numpy(), added["n"].to_numpy(), added["inertia"].to_numpy()
    return [(n[a:b], sums[a:b], float(inertia[a:b].sum())) for a, b in zip(edges, edges[1:])]


def fit(points: DataFrame, ks: list[int], starts: int = STARTS, seed: int = 42, passes: int = PASSES) -> list[Fitted]:
    """A model for each of ks: of its starts the one of the least inertia (of equal ones the first).

    points is a written table (units). Models that rest are not passed over again. A centre without vectors stays.
    """
    spread = points.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("s")).agg(F.avg("s")).first()[0] or 0.0
    begun = seeds(points, max(ks), starts, seed)
    models = [Fitted(k, s, c[:k].copy()) for k in ks for s, c in enumerate(begun)]
    if not models:
        return []
    most = max(1, BLOCK_BYTES // (8 * max(ks) * models[0].centres.shape[1]))
    for low in range(0, len(models), most):
        moving = models[low : low + most]
        for _ in range(passes):
            still = []
            for model, (n, sums, inertia) in zip(moving, _pass(points, moving), strict=True):
                model.inertia, model.passes = inertia, model.passes + 1
                moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], model.centres)
                shift = float(((moved - model.centres) ** 2).sum())
                model.centres = moved
                if shift > REST * spread:
                    still.append(model)
            if not still:
                break
            moving = still
    for low in range(0, len(models), most):
        for model, (_, _, inertia) in zip(models[low : low + most], _pass(points, models[low : low + most]), strict=True):
            model.inertia = inertia
    return [min((m for m in models if m.k == k), key=lambda m: (round(m.inertia, 9), m.start)) for k in ks]


def nearest(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """query_id, cluster_id, cluster_size of the row nearest each centre among those that it is nearest to; ties go to the smaller id and centre."""
    held, kind = points.sparkSession.sparkContext.broadcast(centres), points.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.round(_far(_matrix(batch.column(1)), held.value), 9) if batch.num_rows else np.zeros((0, len(held.value)))
            at = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(far[np.arange(len(at)), at])], ["query_id", "cluster_id", "far"])

    placed = points.select("query_id", "v").mapInArrow(run, f"query_id {kind}, cluster_id int, far double")
    best = placed.groupBy("cluster_id").agg(F.min(F.struct("far", "query_id")).alias("m"), F.count("*").alias("cluster_size"))
    return best.select(F.col("m.query_id").alias("query_id"), "cluster_id", "cluster_size")


def representatives(vectors: DataFrame, closed: bool = False, small: int = 0, seed: int = 42, id_col: str = "query_id", starts: int = STARTS) -> DataFrame:
    """id, cluster_id, cluster_size of one row for each cluster; ties go to the smaller id.

    k runs from 5 to 30 or the number of rows, exclusive, or inclusive (one row fewer) with ``closed``, and is
    chosen by the elbow of the inertias. At most ``small`` rows, or too few to try any k, are their own representatives.
    """
    points = storage.write(units(vectors, id_col), "units")
    n = points.count()
    tried = list(range(LEAST, min(MOST, n - 1) + 1) if closed else range(LEAST, min(MOST, n)))
    if n <= small or not tried:
        return points.select("query_id", F.col("query_id").cast("int").alias("cluster_id"), F.lit(1).cast("long").alias("cluster_size"))
    k = min(elbow([m.inertia for m in fit(points, tried, starts, seed)]), n)
    return nearest(points, fit(points, [k], starts, seed)[0].centres)
