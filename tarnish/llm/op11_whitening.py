"""Whitening of embeddings by spectrum slicing.

Entries become whole numbers, x = floor(256 * c). The fit list holds each distinct x vector once. Its leading principal
components are found from the covariance alone: the inertia of V - sI, read off a pivoted LDLᵀ factorisation, counts the
eigenvalues above s; bisection on such counts isolates the eigenvalue of each number; Rayleigh quotient iteration, started
inside the isolated interval, converges cubically to its vector; and two more counts just below and above the value certify
that it has this number. No other eigensolver is used.

Scale: vectors are deduplicated by a shuffle with map-side combine and stored once. Sums are exact whole numbers; the centred
products are summed by task to one d x d matrix and the tasks' rows of it are added in parallel, as a stream. The driver holds
one d x d matrix, whatever the number of rows, and ships four vectors back; scores are one narrow pass over all rows.

Defined results: a vector that is null or holds null or non-finite entries is dropped; repeated rows and repeated ids are all
returned, equal vectors with equal scores; vectors of another length are a space of their own, with its own fit list and
components (identity_error is the largest over all spaces); a component whose eigenvalue is zero to working precision is left
out, as nothing can be divided by its root, so one distinct vector, empty vectors and an empty table give no rows. Equal eigenvalues are
numbered in any order. A deviation beyond a long is null. Further columns of the table play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm.common import importable, own, table
from tarnish.session import materialize

#: Steps of an entry's unit, and the number of components.
UNIT, COMPONENTS = 256, 4
#: An eigenvalue below this share of the trace counts as zero.
ZERO = 1e-13
_ALPHA = (1 + 17 ** 0.5) / 8
_LONG = 1 << 63


class Space(NamedTuple):
    """What the fit list of one vector length determines."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # their unit vectors, one a column
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


class Factor:
    """LDLᵀ of a symmetric matrix with pivots of one or two rows (partial pivoting by Bunch and Kaufman)."""

    def __init__(self, matrix: np.ndarray):
        a, n = matrix.copy(), len(matrix)
        tiny = np.finfo(float).eps * max(float(np.abs(a).max(initial=0.0)), np.finfo(float).tiny)
        self.order, self.lower, self.blocks = np.arange(n), np.eye(n), []
        k = 0
        while k < n:
            size = self._pivot(a, k)
            pivot = a[k: k + size, k: k + size].copy()
            if size == 1 and abs(pivot[0, 0]) < tiny:
                pivot[0, 0] = tiny if pivot[0, 0] >= 0 else -tiny
            below = a[k + size:, k: k + size]
            rows = np.linalg.solve(pivot, below.T).T if size == 2 else below / pivot[0, 0]
            a[k + size:, k + size:] -= rows @ below.T
            self.lower[k + size:, k: k + size] = rows
            self.blocks.append((k, pivot))
            k += size

    def _swap(self, a: np.ndarray, i: int, j: int, k: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]
            self.lower[[i, j], :k] = self.lower[[j, i], :k]

    def _pivot(self, a: np.ndarray, k: int) -> int:
        """Moves the next pivot to row k; returns its size."""
        column = np.abs(a[k + 1:, k])
        if not len(column) or column.max() == 0 or abs(a[k, k]) >= _ALPHA * column.max():
            return 1
        most = column.max()
        r = k + 1 + int(column.argmax())
        other = np.abs(a[r, k:])
        other[r - k] = 0
        if abs(a[k, k]) * other.max() >= _ALPHA * most * most:
            return 1
        if abs(a[r, r]) >= _ALPHA * other.max():
            self._swap(a, k, r, k)
            return 1
        self._swap(a, k + 1, r, k)
        return 2

    def positive(self) -> int:
        """The number of positive eigenvalues, by Sylvester's law of inertia."""
        found = 0
        for _, p in self.blocks:
            # a pivot of two rows is only chosen when its determinant is negative
            found += 1 if len(p) == 2 else int(p[0, 0] > 0)
        return found

    def solve(self, b: np.ndarray) -> np.ndarray:
        x, n = b[self.order].copy(), len(b)
        for k in range(n):
            x[k + 1:] -= self.lower[k + 1:, k] * x[k]
        for k, p in self.blocks:
            x[k: k + len(p)] = np.linalg.solve(p, x[k: k + len(p)])
        for k in range(n - 1, -1, -1):
            x[k] -= self.lower[k + 1:, k] @ x[k + 1:]
        out = np.empty(n)
        out[self.order] = x
        return out


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a positive semidefinite matrix, ``most`` at the most, and their vectors as columns."""
    d = len(matrix)
    trace = float(np.trace(matrix))
    if trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    eye, close = np.eye(d), 4 * np.finfo(float).eps * norm
    counted: dict[float, int] = {0.0: d, norm * 1.001: 0}

    def factor(shift: float) -> Factor:
        found = Factor(matrix - shift * eye)
        counted[shift] = found.positive()
        return found

    values: list[float] = []
    vectors = np.zeros((d, 0))
    random = np.random.default_rng(11)
    for number in range(1, min(most, d) + 1):
        def interval() -> tuple[float, float]:
            return (max(s for s, c in counted.items() if c >= number), min(s for s, c in counted.items() if c < number))

        low, high = interval()
        while (counted[low], counted[high]) != (number, number - 1) and high - low > close and high > ZERO * trace:
            factor((low + high) / 2)
            low, high = interval()
        if high <= ZERO * trace:
            break
        x = random.standard_normal(d)
        shift, best = (low + high) / 2, (np.inf, 0.0, x)
        for step in range(60):
            x -= vectors @ (vectors.T @ x)
            x = factor(shift).solve(x / np.linalg.norm(x))
            for _ in range(2):
                x -= vectors @ (vectors.T @ x)
                x /= np.linalg.norm(x)
            value = float(x @ matrix @ x)
            residual = float(np.linalg.norm(matrix @ x - value * x))
            low, high = interval()
            inside = low - close <= value <= high + close
            if inside and residual < best[0]:
                best = (residual, value, x.copy())
            elif inside and best[0] <= 64 * close:
                break  # no further gain: converged to rounding
            if inside and residual == 0:
                break
            # the Rayleigh quotient is the next shift; outside the interval a bisection step takes its place
            shift = value if inside and step else (low + high) / 2
        residual, value, x = best
        if not residual <= 1e-9 * norm:
            raise ArithmeticError(f"component {number} didn't converge")
        if value <= ZERO * trace:
            break
        margin = residual + 16 * d * np.finfo(float).eps * norm
        factor(value - margin)
        factor(value + margin)
        if not counted[value + margin] < number <= counted[value - margin]:
            raise ArithmeticError(f"counts don't certify component {number}")
        values.append(value)
        vectors = np.column_stack([vectors, x if x[np.abs(x).argmax()] > 0 else -x])
    return np.array(values), vectors


def whole_vectors(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and x, the whole numbers of each usable vector."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return own(rows, *keep, "embedding").where(F.col("embedding").isNotNull() & fine).select(
        *keep, F.transform("embedding", lambda c: F.floor(c.cast("double") * UNIT).cast("bigint")).alias("x"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a batch, for each vector length: the numbers of the rows and their vectors as a matrix."""
    column = batch.column("x")
    sizes = np.asarray(column.value_lengths())
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """x itself if results up to ``bound`` fit its type, else as Python's whole numbers."""
    return x if bound < _LONG else x.astype(object)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each vector length: the number of vectors and the sum of each dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for at, x in matrices(batch):
                part = exact(x, int(np.abs(x.astype(float)).max()) * len(x) * 2).sum(axis=0)
                n, s = total.get(x.shape[1], (0, 0))
                total[x.shape[1]] = [n + len(at), s + part.astype(object)]
        rows = [(d, i, n, int(v)) for d, (n, s) in total.items() for i, v in enumerate(s)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["d", "i", "n", "s"])

    out: dict[int, tuple[int, list[int]]] = {}
    found = fit.mapInArrow(run, "d int, i int, n bigint, s decimal(38,0)").groupBy("d", "i").agg(
        F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    for r in sorted(found.collect(), key=lambda r: (r["d"], r["i"])):  # a row for each dimension
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _row_batch(total: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([total[k] for k in keys], pa.list_(pa.float64()))], names=["d", "i", "row"])


def covariances(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, np.ndarray]:
    """For each vector length the covariance of the fit list, centred before multiplying, divisor n."""
    means = {d: s.mean for d, s in spaces.items()}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                d = x.shape[1]
                centred = x - means[d]
                total[d] = total.get(d, 0) + centred.T @ centred
        yield _row_batch({(d, i): m[i] for d, m in total.items() for i in range(d)})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows = batch.column("row")
            for k, (d, i) in enumerate(zip(batch.column("d").to_pylist(), batch.column("i").to_pylist())):
                total[d, i] = total.get((d, i), 0) + rows[k].values.to_numpy()
        yield _row_batch(total)

    schema = "d int, i int, row array<double>"
    rows = fit.mapInArrow(products, schema).repartition("d", "i").mapInArrow(added, schema)
    out = {d: np.zeros((d, d)) for d in spaces}
    for r in rows.toLocalIterator():  # d rows of d numbers
        out[r["d"]][r["i"]] = r["row"]
    return {d: (v + v.T) / (2 * spaces[d].n) for d, v in out.items()}


def fitted(fit: DataFrame) -> dict[int, Space]:
    """The components of each vector length of a fit list (column x)."""
    spaces = {d: Space(n, s, np.zeros(0), np.zeros((d, 0)), 0.0) for d, (n, s) in sums(fit).items()}
    if not spaces:
        return {}
    return {d: Space(spaces[d].n, spaces[d].sums, *leading(v, COMPONENTS), float(np.trace(v)))
            for d, v in covariances(fit, spaces).items()}


def scores(x: np.ndarray, space: Space, mean: np.ndarray) -> np.ndarray:
    return (x - mean) @ space.vectors / np.sqrt(space.values)


def identity_error(fit: DataFrame, spaces: dict[int, Space]) -> float:
    """The largest absolute entry, over all spaces, of the covariance of the fit list's scores minus the identity."""
    means = {d: s.mean for d, s in spaces.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                y = scores(x, spaces[x.shape[1]], means[x.shape[1]])
                with_one = np.column_stack([y, np.ones(len(y))])  # its last row of products holds the sums
                total[x.shape[1]] = total.get(x.shape[1], 0) + with_one.T @ with_one
        rows = [(d, i, j, float(v)) for d, m in total.items() for (i, j), v in np.ndenumerate(m)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["d", "i", "j", "v"])

    found = fit.mapInArrow(run, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    worst = 0.0
    products = {(r["d"], r["i"], r["j"]): r["v"] for r in found.collect()}  # 25 numbers a length
    for d, s in spaces.items():
        k = len(s.values)
        m = np.array([[products[d, i, j] for j in range(k + 1)] for i in range(k + 1)]) / s.n
        if k:
            worst = max(worst, float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max()))
    return worst


def deviations(x: np.ndarray, space: Space) -> list[int | None]:
    """Of each row, the sum over dimensions of (n * x - S)^2; null beyond a long."""
    largest = space.n * int(np.abs(x.astype(float)).max(initial=0)) * 2 + max(map(abs, space.sums), default=0)
    wide = exact(x, largest * largest * len(space.sums))
    kind = wide.dtype if wide.dtype == object else np.int64
    found = ((space.n * wide - np.array(space.sums, dtype=kind)) ** 2).sum(axis=1)
    return [int(v) if v < _LONG else None for v in found.tolist()]


def whitened(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of every usable row of rows."""
    vectors = whole_vectors(rows, key)
    fit = materialize(vectors.select("x").distinct(), "whitening_fit")
    spaces = fitted(fit)
    error = identity_error(fit, spaces) if spaces else 0.0
    means = {d: s.mean for d, s in spaces.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch):
                space = spaces[x.shape[1]]
                k = len(space.values)
                if not k:
                    continue
                y = scores(x, space, means[x.shape[1]])
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(key).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(each), space.n), pa.int64()),
                    pa.array(deviations(x, space), pa.int64()).take(pa.array(each)), pa.array(y.ravel()),
                    pa.array(np.tile(space.values / space.trace, len(x)))],
                    names=[key, "component", "n", "deviation", "whitened", "explained"])

    kind = vectors.schema[key].dataType.simpleString()
    out = vectors.mapInArrow(
        run, f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double")
    return out.withColumn("identity_error", F.lit(error))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return whitened(table(spark, sf_dir, "embeddings"))
