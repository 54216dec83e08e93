"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries c become whole numbers x = floor(64 c) + 1000000.  V is the covariance of x over all rows that take part.  It is never formed: a pass over the table multiplies
it with a block of vectors, V Q = Xc'(Xc Q) / n, where every task sums its own rows (centred before multiplying) and sums of tasks are added in a second step.

1. A few Lanczos passes bound the spectrum from below.
2. A random block with ``GUARDS`` more columns than wanted is filtered by the Chebyshev polynomial (three-term recurrence, one pass a degree) that is small
   between that bound and the block's least Ritz value, and grows fast above: the unwanted part of the spectrum fades.
3. QR, then Rayleigh-Ritz with one more pass, which also gives the residuals |V q - e q| of all Ritz pairs.
4. Until all wanted pairs are certified: residuals of at most ``TOLERANCE`` times the largest eigenvalue.  If ``ROUNDS`` rounds don't get there (eigenvalues that hardly differ
   beyond the guards), the block doubles; a block of all dimensions is exact after one Rayleigh-Ritz step.

Blocks are of dimensions times columns: their size doesn't depend on the number of rows.  Sums, means and the trace are exact whole numbers.

Rows with a null vector, or with null or non-finite entries, take no part; nor do rows whose number of entries is not that of most rows (ties: the larger number), or with entries of
2^40 or more in size.  Other columns may be there and are left out; rows that repeat stay rows.  Components whose eigenvalue is not above 1e-12 of the largest (fewer
independent directions than components; a single row; all rows alike) have no whitened value and are left out.  An empty table gives no rows.
``deviation`` is null where the exact number exceeds a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import partitions, stored

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS, GUARDS = 32, 8
#: Residual of a certified pair, as a share of the largest eigenvalue; eigenvalues up to this share are zero.
TOLERANCE, ZERO = 3e-14, 1e-12
#: Degree of the filter, passes of the lower bound, rounds before the block grows.
DEGREE, LANCZOS, ROUNDS = 12, 10, 12
LARGEST = float(1 << 40)
#: Arrays of single tasks that the driver adds up itself.
FEW = 64


@dataclass
class Fit:
    """n, sums (exact), mean split into a whole part and a rest, eigenvalues, eigenvectors (columns), trace, residuals, passes over the table."""

    n: int
    sums: list[int]
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def prepared(docs: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Stored (key, x): whole numbers less SHIFT as little-endian 64-bit integers, of the rows that take part."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LARGEST)
    rows = docs.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("c")).filter(F.col("c").isNotNull()).filter(F.forall("c", entry))
    sizes = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False) * SCALE).astype("<i8")
            offsets = pa.py_buffer((np.arange(b.num_rows + 1) * 8 * d).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, offsets, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())], ["key", "x"])

    kind = dict(docs.dtypes)[key]
    return stored(rows.filter(F.size("c") == d).mapInArrow(run, f"key {kind}, x binary"), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a batch as a matrix of whole numbers."""
    raw = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(raw, dtype="<i8").reshape(len(column), -1)


def _added(parts: DataFrame, tasks: int, shape: tuple[int, ...], exact: bool) -> np.ndarray | list[int]:
    """Adds up one array a task.  With more than FEW tasks they are added in groups in a second step, so that at most FEW arrays reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(1):
                y = np.array([int(v) for v in x.as_py().split(b",")], dtype=object) if exact else np.frombuffer(x.as_buffer(), dtype="<f8")
                total = y if total is None else total + y
        if total is not None:
            raw = ",".join(map(str, total)).encode() if exact else np.asarray(total, dtype="<f8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([raw], pa.binary())], ["at", "part"])

    if tasks > FEW:
        n = min(partitions(parts.sparkSession), FEW)
        parts = parts.repartition(n, F.pmod(F.col("at"), F.lit(n))).mapInArrow(run, "at int, part binary")
    rows = parts.collect()
    if exact:
        out = [0] * int(np.prod(shape))
        for r in rows:
            out = [a + int(b) for a, b in zip(out, r["part"].split(b","))]
        return out
    out = np.zeros(int(np.prod(shape)))
    for r in rows:
        out += np.frombuffer(r["part"], dtype="<f8")
    return out.reshape(shape)


def _each_task(rows: DataFrame, start: Callable[[], object], add: Callable[[object, np.ndarray], object], final: Callable[[object], bytes]) -> DataFrame:
    """(at, part): what every task makes of its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_rows = start(), False
        for b in batches:
            if b.num_rows:
                total, any_rows = add(total, _matrix(b.column(0))), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([final(total)], pa.binary())], ["at", "part"])

    return rows.select("x").mapInArrow(run, "at int, part binary")


def _sums(rows: DataFrame, d: int, tasks: int) -> tuple[int, list[int], int]:
    """Number of rows, sums of the entries and of their squares (all less SHIFT), exact.  Entries are cut into 20-bit halves so that batch sums fit."""
    def add(total: list[int], x: np.ndarray) -> list[int]:
        high, low = x >> 20, x & 0xFFFFF
        squares = int((high * high).sum()) * (1 << 40) + 2 * int((high * low).sum()) * (1 << 20) + int((low * low).sum())
        new = [len(x), *(int(h) * (1 << 20) + int(v) for h, v in zip(high.sum(0), low.sum(0))), squares]
        return [a + b for a, b in zip(total, new)]

    got = _added(_each_task(rows, lambda: [0] * (d + 2), add, lambda t: ",".join(map(str, t)).encode()), tasks, (d + 2,), True)
    return got[0], got[1:-1], got[-1]


def fit(rows: DataFrame, components: int = COMPONENTS, guards: int = GUARDS, degree: int = DEGREE, seed: int = 7) -> Fit | None:
    """Largest eigenpairs of the covariance of prepared rows; None without rows or dimensions."""
    first = rows.select(F.octet_length("x").alias("size")).first()
    if first is None or not first["size"]:
        return None
    d, tasks = first["size"] // 8, rows.rdd.getNumPartitions()
    n, sums, squares = _sums(rows, d, tasks)
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(w)) / n for s, w in zip(sums, whole)])
    k = min(components, d)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        """V q, in one pass."""
        nonlocal passes
        passes += 1
        width = q.shape[1]

        def add(total: np.ndarray, x: np.ndarray) -> np.ndarray:
            c = (x - whole) - rest
            return total + c.T @ (c @ q)

        return _added(_each_task(rows, lambda: np.zeros((d, width)), add, lambda t: t.astype("<f8").tobytes()), tasks, (d, width), False) / n

    r = np.random.default_rng(seed)
    low = 0.0
    p = min(d, k + guards)
    if p < d and trace > 0:
        low = _lower_bound(times, d, r)
    q = np.linalg.qr(r.standard_normal((d, p)))[0]
    values, q, residual = _rayleigh_ritz(times, q)
    rounds, best = 0, np.inf
    while trace > 0 and p < d:
        worst = residual[:k].max()
        if worst <= TOLERANCE * values[0]:
            break
        # a residual that no longer falls is at the limit of the arithmetic
        if worst <= 100 * TOLERANCE * values[0] and worst > best / 2:
            break
        best, rounds = min(best, worst), rounds + 1
        if rounds % ROUNDS == 0:
            p, best = min(d, 2 * p), np.inf
            q = np.linalg.qr(np.hstack([q, r.standard_normal((d, p - q.shape[1]))]))[0]
            values, q, residual = _rayleigh_ritz(times, q)
            continue
        q = np.linalg.qr(_filtered(times, q, low, values[-1], values[0], degree))[0]
        values, q, residual = _rayleigh_ritz(times, q)
    wanted = min(k, int((values > ZERO * max(values[0], 0)).sum())) if trace > 0 else 0
    return Fit(n, [s + n * SHIFT for s in sums], whole, rest, values[:wanted], q[:, :wanted], trace, residual[:wanted], passes)


def _lower_bound(times: Callable[[np.ndarray], np.ndarray], d: int, r: np.random.Generator) -> float:
    """Below all eigenvalues, nearly surely: the least Ritz value of a Lanczos run less its residual, 0 at least."""
    basis = [v := r.standard_normal(d)]
    basis[0] = v / np.linalg.norm(v)
    diagonal, beside = [], []
    for _ in range(min(LANCZOS, d)):
        w = times(basis[-1][:, None])[:, 0]
        diagonal.append(float(basis[-1] @ w))
        for _ in range(2):  # against all earlier ones, twice for orthogonality
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * max(abs(diagonal[0]), 1e-300):
            break
        basis.append(w / beside[-1])
    off = beside[:-1]
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    return max(0.0, float(values[0] - beside[-1] * abs(vectors[-1, 0])))


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V that is at most 1 on [low, high], times q, scaled by its size at ``top``."""
    centre, half = (high + low) / 2, (high - low) / 2
    if half <= 0:
        return times(q)
    sigma = first = half / (top - centre)
    before, now = q, (times(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def _rayleigh_ritz(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and residuals in the span of q."""
    w = times(q)
    h = q.T @ w
    values, y = np.linalg.eigh((h + h.T) / 2)
    values, y = values[::-1], y[:, ::-1]
    q, w = q @ y, w @ y
    return values, q, np.linalg.norm(w - q * values, axis=0)


def identity_error(rows: DataFrame, f: Fit) -> float:
    """Largest entry, in size, of the whitened rows' covariance less the identity; one more pass."""
    scale = f.vectors / np.sqrt(f.values)
    k = len(f.values)

    def add(total: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = ((x - f.whole) - f.rest) @ scale
        return total + np.vstack([z.T @ z, z.sum(0)])

    got = _added(_each_task(rows, lambda: np.zeros((k + 1, k)), add, lambda t: t.astype("<f8").tobytes()), rows.rdd.getNumPartitions(), (k + 1, k), False) / f.n
    return float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(k)).max())


def whiten(rows: DataFrame, f: Fit | None, key: str = "vec_id") -> DataFrame:
    """One row for each prepared row: ``key``, deviation (exact), whitened (array of double, a value a component)."""
    kind = dict(rows.dtypes)["key"]
    if f is None or not len(f.values):
        return rows.limit(0).select(F.col("key").alias(key), F.lit(0).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    scale = f.vectors / np.sqrt(f.values)
    shifted = [s - f.n * SHIFT for s in f.sums]
    left = [s - f.n * int(w) for s, w in zip(shifted, f.whole)]  # n x - S = n (x - whole) - left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = _matrix(b.column(1)) - f.whole
            about = ((c * float(f.n) - np.array(left, dtype=float)) ** 2).sum(1)
            with np.errstate(over="ignore"):
                exact = ((c * f.n - np.array([v % (1 << 63) for v in left], dtype=np.int64)) ** 2).sum(1) if f.n < 1 << 62 else np.zeros(len(c), np.int64)
            values = [int(v) if a < 9e18 else None for v, a in zip(exact.tolist(), about.tolist())]
            z = (c - f.rest) @ scale
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], ["key", "deviation", "whitened"])

    return rows.mapInArrow(run, f"key {kind}, deviation long, whitened array<double>").withColumnRenamed("key", key)


def digest(docs: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component."""
    rows = prepared(docs)
    f = fit(rows, components)
    error = identity_error(rows, f) if f is not None and len(f.values) else 0.0
    shares = [float(e) / f.trace for e in f.values] if f is not None else []
    out = whiten(rows, f).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(f.n if f is not None else 0).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(F.array([F.lit(s) for s in shares] or [F.lit(0.0)]), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
