"""Whitening of vectors by an exact scatter matrix.

Entries become whole numbers x = floor(64 * c) + 1000000. A first pass counts and sums them, so that
y = n * x - S, centred before anything is multiplied, is a whole number too. A second pass multiplies
y^T y modulo several primes, each task by matrix products whose sums doubles hold exactly; the residues
of all tasks are summed and the Chinese remainder theorem gives every entry of the scatter as it is,
whatever the order of rows or tasks. Its quotient by n^3 is rounded once, and eigh in doubles gives the
components. A third pass measures how far the whitened vectors' covariance is from the identity.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are vectors of another
length than most have (of equally many the longer). Repeated rows count as often as they occur; an id may
be null. 64 * c beyond 2^62 becomes 2^62 with its sign. Components whose variance is zero to double precision
are left out, so a table without vectors, with a single one or with equal ones has no component. Components
of one eigenvalue are some basis of its space, the same for all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from quarry.llm.common import map_arrow, materialize

SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 62
#: Primes are below 2^20 and residues lie around zero: products of 2^13 rows sum to less than 2^53.
PRIME_BITS, BLOCK_ROWS = 20, 1 << 13
COMPONENTS = 32


@dataclass
class Model:
    n: int
    sums: list[int]  # of x by dimension
    largest: int  # no |n * x - S| is above it
    components: np.ndarray  # dimensions by components, unit columns
    eigenvalues: np.ndarray  # falling
    explained: np.ndarray  # shares of the trace
    scatter: np.ndarray = field(repr=False, default=None)  # exact: sum of (n * x - S)(n * x - S)^T

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def primes(product: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS, as many as it takes for a product above the one given."""
    found, have, candidate = [], 1, (1 << PRIME_BITS) - 1
    while have <= product:
        if all(candidate % k for k in range(3, math.isqrt(candidate) + 1, 2)):
            found.append(candidate)
            have *= candidate
        candidate -= 2
    return found


def remainder(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The whole numbers nearest zero with these residues, as an array of Python's."""
    whole = math.prod(moduli)
    total = 0
    for r, p in zip(residues, moduli, strict=True):
        rest = whole // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % whole
    return np.where(total > whole // 2, total - whole, total)


def entries(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows that have this many entries, all finite, and their x."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == length)
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)
    fine = np.isfinite(values).all(axis=1)  # null entries have become NaN
    scaled = np.floor(SCALE * values[fine]) if fine.any() else np.zeros((0, length))
    far = np.abs(scaled) >= LARGEST
    x = np.where(far, 0, scaled).astype(np.int64)
    return at[fine], np.where(far, np.where(scaled > 0, LARGEST, -LARGEST), x) + OFFSET


def _vectors(vectors: DataFrame, vec_col: str):
    kind = vectors.schema[vec_col].dataType.elementType
    return F.col(f"`{vec_col}`") if isinstance(kind, DoubleType | FloatType) else F.col(f"`{vec_col}`").cast("array<double>")


def moments(vectors: DataFrame, vec_col: str) -> tuple[int, list[int], int]:
    """n, the sums of x, and a bound on |n * x - S|, over the vectors of the commonest length; (0, [], 0) without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths().fill_null(0))
            for length in np.unique(sizes[sizes > 0]):
                _, x = entries(batch.column(0), int(length))
                if len(x):
                    columns = [np.full(length, length), np.arange(length), np.full(length, len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["size", "dim", "n", "high", "low", "least", "most"])

    parts = map_arrow(vectors.select(_vectors(vectors, vec_col).alias("v")), run, "size long, dim long, n long, high long, low long, least long, most long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    summed = materialize(parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), exact("high"), exact("low"), F.min("least").alias("least"), F.max("most").alias("most")), "moments")
    commonest = summed.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if commonest is None:
        return 0, [], 0
    rows = summed.where(F.col("size") == commonest["size"]).orderBy("dim").collect()  # one row a dimension
    n, sums = commonest.n, [(int(r.high) << 32) + int(r.low) for r in rows]
    return n, sums, max(max(n * r.most - s, s - n * r.least) for r, s in zip(rows, sums, strict=True))


def scatter(vectors: DataFrame, vec_col: str, n: int, sums: list[int], largest: int) -> np.ndarray:
    """The exact sum of (n * x - S)(n * x - S)^T, by residues; the driver gets one number a pair of dimensions and prime."""
    moduli, size = primes(2 * n * largest * largest), len(sums)
    shifts = [np.array([s % p for s in sums]) for p in moduli]
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(moduli), size, size), np.int64)
        for batch in batches:
            _, x = entries(batch.column(0), size)
            for i in range(0, len(x), BLOCK_ROWS):
                for j, p in enumerate(moduli):
                    y = (x[i : i + BLOCK_ROWS] % p * (n % p) - shifts[j]) % p
                    y = np.where(y > p // 2, y - p, y).astype(np.float64)
                    found[j] = (found[j] + (y.T @ y).astype(np.int64)) % p
        yield pa.RecordBatch.from_arrays([pa.array(range(len(moduli)), pa.int32()), pa.array([f[upper] for f in found], pa.list_(pa.int64()))], ["modulus", "residues"])

    parts = map_arrow(vectors.select(_vectors(vectors, vec_col).alias("v")), run, "modulus int, residues array<long>")
    placed = parts.select("modulus", F.posexplode("residues").alias("place", "residue"))
    summed = placed.groupBy("modulus", "place").agg(F.sum("residue").alias("residue")).toArrow()
    table = np.zeros((len(moduli), len(upper[0])), np.int64)
    table[summed["modulus"].to_numpy(), summed["place"].to_numpy()] = summed["residue"].to_numpy()
    full = np.zeros((size, size), object)
    full[upper] = remainder([t % p for t, p in zip(table, moduli, strict=True)], moduli)
    full.T[upper] = full[upper]
    return full


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Model:
    """The model of all vectors; at most ``components`` components."""
    n, sums, largest = moments(vectors, vec_col)
    if not largest:  # no vector, or all are equal
        return Model(n, sums, largest, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0))
    exact = scatter(vectors, vec_col, n, sums, largest)
    covariance = (exact / n**3).astype(np.float64)  # each quotient of whole numbers is rounded once
    values, columns = np.linalg.eigh(covariance)
    order = [i for i in np.argsort(-values) if values[i] > len(sums) * np.finfo(float).eps * values[-1]][:components]
    trace = exact.trace() / n**3
    return Model(n, sums, largest, columns[:, order], values[order], values[order] / trace, exact)


class Whitener:
    """What a task does with a model: exact deviations and whitened vectors of a batch."""

    def __init__(self, model: Model):
        self.model, self.size, self.projection = model, len(model.sums), model.projection
        self.fits = self.size * model.largest**2 < 1 << 63  # then no product below leaves a long

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        n, sums = self.model.n, self.model.sums
        if not self.fits:
            return x.astype(object) * n - np.array(sums, object)
        return (x - np.array([s // n for s in sums], np.int64)) * n - np.array([s % n for s in sums], np.int64)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, x = entries(column, self.size)
        y = self.centred(x)
        return at, (y * y).sum(axis=1), (y / self.model.n).astype(np.float64) @ self.projection


def identity_error(vectors: DataFrame, model: Model, vec_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n) minus the identity; 0 without components."""
    width = len(model.eigenvalues)
    if not width:
        return 0.0
    held, upper = vectors.sparkSession.sparkContext.broadcast(model), np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whiten, total = Whitener(held.value), np.zeros(width + len(upper[0]))
        for batch in batches:
            _, _, w = whiten(batch.column(0))
            total += np.concatenate((w.sum(axis=0), (w.T @ w)[upper]))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    parts = map_arrow(vectors.select(_vectors(vectors, vec_col).alias("v")), run, "sums array<double>")
    rows = parts.select(F.posexplode("sums").alias("place", "part")).groupBy("place").agg(F.sum("part").alias("total")).collect()
    total = np.zeros(width + len(upper[0]))
    for r in rows:  # one a pair of components
        total[r.place] = r.total / model.n
    mean, covariance = total[:width], np.zeros((width, width))
    covariance[upper] = total[width:]
    covariance = covariance - np.triu(np.outer(mean, mean))
    return float(np.abs(covariance - np.eye(width))[upper].max())


def whiten(vectors: DataFrame, model: Model, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, deviation decimal(38,0) (the sum of (n * x - S)^2; null from 10^38 on) and whitened array<double> of each remaining row."""
    held, kind = vectors.sparkSession.sparkContext.broadcast(model), vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply, deep = Whitener(held.value), pa.decimal128(38, 0)
        for batch in batches:
            at, deviation, w = apply(batch.column(1))
            if deviation.dtype == object:
                exact = pa.array([Decimal(d) if d < 10**38 else None for d in deviation], deep)
            else:
                exact = pa.array(deviation).cast(pa.decimal128(19, 0)).cast(deep)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), exact, lists], [id_col, "deviation", "whitened"])

    source = vectors.select(F.col(f"`{id_col}`"), _vectors(vectors, vec_col).alias("entries"))
    return map_arrow(source, run, f"`{id_col}` {kind}, deviation decimal(38,0), whitened array<double>")
