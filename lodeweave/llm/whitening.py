"""Whitening of embeddings by spectrum slicing.

Vectors are put on a fixed grid of whole numbers, so that sums and deviations are exact. The covariance of the distinct ones
comes from sums over partitions; its leading eigenvalues are found one by one: the number of positive pivots of the LDL'
factors of the shifted covariance is the number of eigenvalues above the shift, bisection by that count isolates an eigenvalue,
Rayleigh quotient iteration finds it with its vector, and counts on both sides of the result certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.materialize import discard, materialize

GRID, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Grid values are held within these bounds, so that they and their sums are exact; no 32-bit entry below 1e16 in size reaches them.
MOST = 1 << 60
#: Vectors of a block of the matrix products.
_BLOCK = 4096
_PIVOT = (1 + 17**0.5) / 8


def on_grid(vector: Column) -> Column:
    """``floor(64 * c) + 1000000`` of each entry as long, within ``MOST`` of 0."""

    def entry(c: Column) -> Column:
        x = F.greatest(F.least(c.cast("double") * GRID, F.lit(float(MOST))), F.lit(-float(MOST)))
        return F.floor(x) + OFFSET

    return F.transform(vector, entry)


def usable(vector: Column) -> Column:
    """Whether a vector is there and has no null and no non-finite entry."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """The numbers of positive, negative and zero pivots of the LDL' factors of a symmetric matrix (Bunch-Kaufman pivots)."""
    a = np.array(a, np.float64)
    n, k = len(a), 0
    positive = negative = 0
    tiny = np.abs(a).max(initial=0.0) * 1e-300
    while k < n:
        own = abs(a[k, k])
        below = np.abs(a[k + 1 :, k])
        far = float(below.max(initial=0.0))
        if max(own, far) <= tiny:
            k += 1
            continue
        size, pivot = 1, k
        if own < _PIVOT * far:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            most = float(row.max())
            if own * most < _PIVOT * far * far:
                size, pivot = (1, r) if abs(a[r, r]) >= _PIVOT * most else (2, r)
        at = k + size - 1
        if pivot != at:
            a[[at, pivot]] = a[[pivot, at]]
            a[:, [at, pivot]] = a[:, [pivot, at]]
        if size == 1:
            d, column = a[k, k], a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(column, column / d)
            positive, negative = positive + (d > 0), negative + (d < 0)
        else:  # such a block has one eigenvalue of each sign
            block, columns = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= columns @ np.linalg.solve(block, columns.T)
            positive, negative = positive + 1, negative + 1
        k += size
    return positive, negative, n - positive - negative


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are greater than ``shift``."""
    return inertia(v - shift * np.eye(len(v)))[0]


def leading_eigenpairs(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a positive semidefinite matrix, falling, and their unit vectors as columns; at most so many, and only positive ones.

    Eigenvalues that are equal to rounding stay in one interval; their vectors are found at right angles to each other. A
    result that the counts don't certify raises.
    """
    d = len(v)
    v = (v + v.T) / 2
    top = float(np.abs(v).sum(1).max(initial=0.0))
    tolerance = max(1, d) * np.finfo(np.float64).eps * top
    wanted = min(most, above(v, 16 * tolerance)) if top > 0 else 0
    counts: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(v, shift)
        return counts[shift]

    values: list[float] = []
    vectors = np.zeros((d, 0))
    rng = np.random.default_rng(11)
    counts[top * 1.001] = 0
    while len(values) < wanted:
        done = len(values)
        # the next eigenvalue alone in (low, high], with a margin that makes the iteration converge to it
        high = min(s for s, n in counts.items() if n == done) if done else top * 1.001
        low = max([s for s, n in counts.items() if n > done], default=8 * tolerance)
        while high - low > 8 * tolerance and (count(low) > done + 1 or high - low > 1e-3 * high):
            middle = (low + high) / 2
            n = count(middle)
            low, high = (middle, high) if n > done else (low, middle)
        group = max(1, count(low) - done)
        found = [_eigenpair(v, low, high, vectors, rng, tolerance)]
        for _ in range(min(group, d - done) - 1):
            found.append(_eigenpair(v, low, high, np.column_stack([vectors, *[x for _, x in found]]), rng, tolerance))
        found.sort(key=lambda pair: -pair[0])
        values += [e for e, _ in found]
        vectors = np.column_stack([vectors, *[x for _, x in found]])
        margin = 64 * tolerance
        if above(v, found[0][0] + margin) > done or above(v, found[-1][0] - margin) < len(values):
            raise ArithmeticError("the counts of eigenvalues don't certify the numbering")
        counts[found[-1][0] - margin] = above(v, found[-1][0] - margin)
        if counts[found[-1][0] - margin] > len(values):  # the next one is equal to rounding
            counts[found[-1][0]] = len(values)
    return np.array(values[:wanted]), vectors[:, :wanted]


def _eigenpair(v: np.ndarray, low: float, high: float, found: np.ndarray, rng: np.random.Generator, tolerance: float) -> tuple[float, np.ndarray]:
    """An eigenvalue in (low, high] whose vector is at right angles to those found: inverse iteration from the middle, then Rayleigh quotients."""

    def across(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - found @ (found.T @ x)
        return x / np.linalg.norm(x)

    def step(x: np.ndarray, shift: float) -> np.ndarray:
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (shift + tolerance) * np.eye(len(v)), x)
        return across(y) if np.isfinite(y).all() else x

    x = across(rng.normal(size=len(v)))
    for _ in range(200):
        x = step(x, (low + high) / 2)
        value = x @ v @ x
        if low - tolerance < value <= high + tolerance and np.linalg.norm(v @ x - value * x) < max((high - low) / 4, 4 * tolerance):
            break
    for _ in range(12):
        if np.linalg.norm(v @ x - value * x) <= tolerance / 4:
            break
        x = step(x, value)
        value = x @ v @ x
    return float(value), x


@dataclass(frozen=True)
class Whitening:
    """What a fit has found: ``n`` vectors with sums ``sums``; ``components`` are unit vectors as columns, ``values`` their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean; the whole part of the mean goes first, so no digit is lost."""
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each vector the sum over its entries of (n * x - sum) squared, exactly."""
        rough = ((x - np.array(self.sums, np.float64) / self.n) ** 2).sum(1) * float(self.n) ** 2
        if len(rough) and rough.max() < 2.0**61 and float(np.abs(x).max(initial=0)) * self.n < 2.0**61:
            apart = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (apart * apart).sum(1).tolist()
        return [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n for s in sums], np.float64) / n


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _product_sums(table: DataFrame, width: int, rows_of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of the table's ``x`` of the outer products of ``rows_of(x)``: a small matrix from each task, added up by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                y = rows_of(_matrix(batch.column(0).slice(at, _BLOCK), width))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = table.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    out = np.zeros((size, size))
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value")).collect():  # a row for each entry of the matrix
        out[i, j] = value
    return (out + out.T) / 2


def fit_whitening(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on ``x``, grid vectors of ``width`` entries, each once; none where there are none or they don't differ."""
    exact = [F.sum(F.get("x", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    n, *sums = distinct.agg(F.count(F.lit(1)), *exact).first()
    if not n or not width:
        return None
    sums = [int(s) for s in sums]
    covariance = _product_sums(distinct, width, lambda x: _centred(x, n, sums), width) / n
    values, vectors = leading_eigenpairs(covariance, components)
    if not len(values):
        return None
    model = Whitening(n, sums, values, vectors, float(np.trace(covariance)), 0.0)
    identity = _product_sums(distinct, width, model.whitened, len(values)) / n
    return Whitening(n, sums, values, vectors, model.trace, float(np.abs(identity - np.eye(len(values))).max()))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector of ``vec_id, embedding`` and component.

    Vectors that are null or hold null, NaN or infinite entries are left out, and so are those of another length than most
    have (the greatest of equally common lengths). Repeated rows and rows without id are whitened each, but a vector counts
    once in the fit. There are as many components as the covariance has positive eigenvalues, ``components`` at most; no
    vectors, empty ones or just one kind of vector give no rows. A deviation beyond a long is null.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where(usable(F.col("e"))).select("vec_id", on_grid(F.col("e")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = lengths["width"] if lengths else 0
    rows = rows.where(F.size("x") == width)
    distinct = materialize(rows.select("x").distinct(), "distinct")
    model = fit_whitening(distinct, width, components)
    discard(distinct)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                x = _matrix(part.column(1), width)
                exact = [d if d < 1 << 63 else None for d in model.deviations(x)]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, model.n), pa.int64()), pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                     pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(x) * k, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by the leading components of the distinct ones."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
