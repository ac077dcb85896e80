"""Embedding whitening: covariance over Spark, its leading eigenvectors by hand, projection by broadcast.

Vectors become integers (256 times each component, floored).  The fit list holds every distinct
integer vector once, so a vector that is repeated a billion times weighs as one.  Its sums are
exact; each task then centres its vectors before it multiplies them and yields one d x d matrix, so
no difference of large products is taken.  The driver gets d x d numbers, whatever the number of rows.

The covariance is reduced to a tridiagonal matrix by Householder reflections, its leading eigenvalues
are bisected with Sturm counts, and inverse iteration gives the eigenvectors, with those of a cluster
of close eigenvalues kept orthogonal.  Components go back through the reflections and are broadcast to the
tasks that project the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.llm.common import prepare, shared_table

#: Dimensions at most: the driver holds a few matrices of this side (2048: 32 MB each).
MAX_DIMS = 2048
#: Eigenvalues closer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3
#: Below this share of the largest eigenvalue a component has no variance to speak of.
NEGLIGIBLE = 1e-13


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and reflection vectors: applying H_k = I - 2 v v' for each vector in turn
    to a symmetric matrix from both sides makes it tridiagonal.  Vector k is zero up to row k."""
    a = np.array(matrix, np.float64)
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        column = a[k + 1:, k]
        scale = np.abs(column[1:]).max()
        v = np.zeros(d)
        if scale > 0:
            part = column / max(scale, abs(column[0]))
            part = part / np.linalg.norm(part)
            part[0] += np.copysign(1.0, part[0])  # the sign that adds: no cancellation
            v[k + 1:] = part / np.linalg.norm(part)
            p = a @ v
            p -= (v @ p) * v
            a -= 2 * (np.outer(v, p) + np.outer(p, v))
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each number of ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    floor = max(tiny, np.finfo(float).eps ** 2 * float(np.max(off * off, initial=0.0)))
    below = np.zeros(len(at), np.int64)
    pivot = np.ones(len(at))
    for i, x in enumerate(diagonal):
        pivot = x - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < floor, -floor, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its interval can't be halved."""
    d = len(diagonal)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    spread = np.maximum(np.abs(low), np.abs(high)) * 2 * np.finfo(float).eps + np.finfo(float).tiny
    low, high = low - spread, high + spread
    wanted = d - np.arange(k)  # eigenvalue i is the smallest number with this many eigenvalues up to it
    while True:
        middle = low + (high - low) / 2
        moving = (middle > low) & (middle < high)
        if not moving.any():
            return high
        enough = counts_below(diagonal, off, middle) >= wanted
        high = np.where(moving & enough, middle, high)
        low = np.where(moving & ~enough, middle, low)


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) x = right by elimination with row exchanges; zero pivots become ``least``."""
    d = len(diagonal)
    main, above, second = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    x = right.copy()
    for i in range(d - 1):
        if abs(off[i]) > abs(main[i]):  # exchange rows i and i + 1
            factor = main[i] / off[i]
            main[i], following, carried = off[i], main[i + 1], above[i + 1]
            main[i + 1], above[i], second[i] = above[i] - factor * following, following, carried
            above[i + 1] = -factor * carried
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if main[i] == 0.0:
                main[i] = least
            factor = off[i] / main[i]
            main[i + 1] -= factor * above[i]
            x[i + 1] -= factor * x[i]
    main = np.where(np.abs(main) < least, np.copysign(least, main), main)
    for i in range(d - 1, -1, -1):
        rest = above[i] * x[i + 1] if i + 1 < d else 0.0
        rest += second[i] * x[i + 2] if i + 2 < d else 0.0
        x[i] = (x[i] - rest) / main[i]
        size = abs(x[i])
        if size > 1e150:  # keep the growing solution in range
            x /= size
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix to eigenvalues in falling order."""
    d = len(diagonal)
    norm = max(float(np.max(np.abs(diagonal), initial=0.0)), float(np.max(np.abs(off), initial=0.0)), np.finfo(float).tiny * 1e20)
    least = np.finfo(float).eps * norm
    rng = np.random.default_rng(0)
    found = np.zeros((d, len(values)))
    start = 0  # first member of the cluster
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            start = i
        # members of a cluster start from shifts that differ, as equal shifts would give one vector
        shift = value - 2 * (i - start) * least
        x = rng.uniform(-1.0, 1.0, d)
        for _ in range(6):
            x = _solve_shifted(diagonal, off, shift, x / np.linalg.norm(x), least)
            x /= np.abs(x).max()
            for _ in range(2):
                x = x - found[:, start:i] @ (found[:, start:i].T @ x)
        found[:, i] = x / np.linalg.norm(x)
    return found


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors (columns)."""
    scale = float(np.abs(matrix).max())
    if scale == 0.0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for v in reversed(mirrors):
        vectors -= 2 * np.outer(v, v @ vectors)
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Whitening:
    """What a fit learns: everything is of the size of the dimensions, not of the rows."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray  # d x k

    @property
    def defined(self) -> np.ndarray:
        """Which components have any variance."""
        return self.values > NEGLIGIBLE * max(float(np.max(self.values, initial=0.0)), 0.0)

    def centre(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean: first less the mean's whole part, exactly, then less the rest of it."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return _less(x, whole) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates, NaN for components without variance."""
        scale = np.where(self.defined, np.sqrt(np.maximum(self.values, 0.0)), np.nan)
        return self.centre(x) @ self.components / scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2 of each row, in whole numbers of any size."""
        if not len(x):
            return []
        most = int(np.abs(x.astype(np.float64)).max(initial=0.0)) + 1
        gap = 2 * (most * self.n + max(map(abs, self.sums), default=0))
        exact = x.astype(object) if gap * gap * len(self.sums) >= 1 << 63 else x
        gaps = exact * self.n - np.array(self.sums, exact.dtype)
        return [int(v) for v in (gaps * gaps).sum(axis=1)]


def _less(x: np.ndarray, whole: list[int]) -> np.ndarray:
    """x - whole as doubles, subtracted in whole numbers."""
    if max(int(np.abs(x.astype(np.float64)).max(initial=0.0)), max(map(abs, whole), default=0)) < 1 << 61:
        return (x - np.array(whole, np.int64)).astype(np.float64)
    return (x.astype(object) - np.array(whole, object)).astype(np.float64)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _per_task(fit: DataFrame, d: int, add: Callable[[np.ndarray], np.ndarray], start: np.ndarray) -> DataFrame:
    """Sum ``add`` of a task's rows, and yield (i, part): the rows of the sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start.copy()
        for b in batches:
            if b.num_rows:
                total = total + add(_matrix(b.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "part"])

    return fit.mapInArrow(run, "i int, part array<double>")


def _exact_sums(fit: DataFrame, d: int) -> list[int]:
    """Sum of each dimension in whole numbers."""
    summed = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    sums = {r["i"]: int(r["s"]) for r in summed.collect()}
    return [sums[i] for i in range(d)]


def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): rows whose vector is there and finite, as whole numbers floor(256 c); beyond the range of a
    long, its end."""
    finite = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))
    return (df.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
            .where(F.col("vector").isNotNull() & F.forall("vector", finite))
            .select("key", F.transform("vector", lambda c: F.floor(256 * c.cast("double"))).alias("x")))


def fit(rows: DataFrame, k: int = 4) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of ``rows`` (column x) and that fit list, written once."""
    listed = shared_table(rows.select("x").distinct(), "fit")
    n = listed.count()
    if not n:
        return None, listed
    d = listed.select(F.size("x").alias("d")).first()["d"]
    if d > MAX_DIMS:
        raise ValueError(f"vectors have {d} dimensions, {MAX_DIMS} at most")
    whitening = Whitening(n, _exact_sums(listed, d), 0.0, np.empty(0), np.empty((d, 0)))

    def products(x: np.ndarray) -> np.ndarray:
        z = whitening.centre(x)
        return z.T @ z

    parts = _per_task(listed, d, products, np.zeros((d, d)))
    cells = parts.select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    matrix = np.zeros((d, d))
    for i, j, v in cells.collect():
        matrix[i, j] = v / n
    matrix = (matrix + matrix.T) / 2
    values, components = leading_components(matrix, min(k, d))
    return Whitening(n, whitening.sums, float(np.trace(matrix)), values, components), listed


def identity_error(whitening: Whitening, listed: DataFrame) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity, over the components
    with variance; None if there are none."""
    good, d = np.flatnonzero(whitening.defined), len(whitening.sums)
    if not len(good):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = whitening.project(_matrix(b.column(0), d))[:, good]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, i])) for i in range(len(good))], names=[f"w{i}" for i in range(len(good))])

    w = listed.mapInArrow(run, ", ".join(f"w{i} double" for i in range(len(good))))
    pairs = [(i, j) for i in range(len(good)) for j in range(i, len(good))]
    found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4) -> DataFrame:
    """Whitened coordinates of every vector in its leading k components.

    Returns a row per row and component: the key, component (from 1, by falling variance), n (distinct
    vectors), deviation (sum over the dimensions of (n x - S)^2), whitened, explained (the component's
    share of the variance), identity_error (one value) and deviation_digits (deviation in
    decimal digits, of any size).

    Rows whose vector is null or holds a null or non-finite number are left out; so are those with
    another number of dimensions than most have (ties: the larger number).  Components beyond 256 c =
    +-2^63 count as that.  Repeated rows come as often as they are there, null keys included; a deviation
    beyond a long is null and only in deviation_digits.  With fewer than k dimensions there are as many
    components; one without variance (a single vector, equal ones) has a null whitened.  An
    empty table gives no rows; other columns are not read."""
    spark = prepare(df.sparkSession)
    kind = df.schema[key].dataType
    schema = (f"key {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, deviation_digits string")
    rows = quantised(df, key, vector).where(F.size("x") > 0)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    d = sizes["d"]
    rows = rows.where(F.size("x") == d)
    whitening, listed = fit(rows, k)
    error = identity_error(whitening, listed)
    spark_model = spark.sparkContext.broadcast(whitening)
    share = (whitening.values / whitening.trace).tolist() if whitening.trace > 0 else [None] * len(whitening.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spark_model.value
        for b in batches:
            x = _matrix(b.column(1), d)
            w, count = model.project(x), len(model.values)
            digits = model.deviations(x)
            again = np.repeat(np.arange(b.num_rows), count)
            flat = w.reshape(-1)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.full(len(again), model.n, np.int64)),
                pa.array([v if v < 1 << 63 else None for v in digits], pa.int64()).take(pa.array(again)),
                pa.array(flat, mask=np.isnan(flat)), pa.array(share * b.num_rows, pa.float64()),
                pa.array([error] * len(again), pa.float64()), pa.array(map(str, digits), pa.string()).take(pa.array(again)),
            ], names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
