"""Whitening of embedding vectors by Chebyshev-filtered subspace iteration.

An entry c becomes the integer floor(64 c) + 1000000, so counts and sums are
exact.  With n vectors and their mean, a *pass* multiplies the covariance V
with a block of vectors: every task sums its rows' (x - mean)' ((x - mean) B)
and Spark adds the tasks' parts.  V itself is never formed; the driver holds
only matrices of one row per dimension.

1. A block of ``components + guard`` random orthonormal columns is the start.
2. Rayleigh-Ritz: the block is turned to its Ritz vectors, the largest Ritz
   value first.  The residual |V q - t q| of the wanted ones is measured.
3. Until every residual is below ``tolerance`` times the largest value, a
   Chebyshev polynomial of V, by its three-term recurrence (one pass a
   degree), is applied to the block.  It is small on the unwanted part of the
   spectrum, between a lower bound and the block's least Ritz value, and grows
   above; QR makes the block orthonormal again.

The lower bound comes from a Lanczos run whose vector rides along as one more
column of the passes.  A flat spectrum costs about 25 passes over the data, a
falling one fewer; where the block holds all dimensions the first pass ends it.

Defined cases: a null or empty vector, or one with a null or non-finite entry,
is left out of fit and result.  Vectors of different lengths are an error.
Repeated rows and null ids count and stay as rows of their own.  Components
are those with a value above 1e-12 of the largest, so a table of equal rows,
of one row or of none gives none.  Extra columns pass through; result columns
whose name the input has get a trailing underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free

COMPONENTS, GUARD, DEGREE, TOLERANCE, MAX_FILTERS, SEED = 32, 16, 6, 3e-14, 60, 7
LANCZOS_STEPS = 24
SCALE, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Whitener:
    """A fit: ``total`` holds the exact sum of each dimension, ``axes`` one
    unit eigenvector a column, ``values`` their eigenvalues."""

    n: int
    total: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values

    @property
    def projection(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)


def _integers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their integer vectors)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64())
    flat = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    keep = (sizes > 0) & (odd[ends] == odd[ends - sizes])
    rows = np.flatnonzero(keep)
    if not len(rows):
        return rows, np.zeros((0, 0), np.int64)
    width = sizes[rows[0]]
    if (sizes[rows] != width).any():
        raise ValueError("embedding vectors must be of one length")
    scaled = np.floor(SCALE * flat[np.repeat(keep, sizes)])
    if np.abs(scaled).max() >= 2.0 ** 62:
        raise ValueError("embedding entries are too large for exact sums")
    return rows, scaled.astype(np.int64).reshape(len(rows), width) + SHIFT


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - total / n, with the whole part of the mean taken off in integers."""
    whole = total // n
    return (x - whole) - (total - n * whole) / n


def _summed(df: DataFrame, column: str, part, kind: str) -> dict[int, float]:
    """The sum over all tasks of the flat arrays that ``part`` gives a batch."""
    typ = {"long": pa.int64(), "double": pa.float64()}[kind]

    def work(batches):
        acc = None
        for batch in batches:
            rows, x = _integers(batch.column(0))
            if len(rows):
                got = part(x)
                acc = got if acc is None else acc + got
        if acc is not None:
            yield pa.record_batch([pa.array(np.arange(len(acc), dtype=np.int32)), pa.array(acc, typ)], names=["at", "v"])

    parts = df.select(column).mapInArrow(work, f"at int, v {kind}")
    return {r.at: r.v for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect()}


class _Passes:
    """Products of the covariance with blocks of columns, and the Lanczos run
    that rides along to bound the spectrum from below."""

    def __init__(self, df: DataFrame, column: str, n: int, total: np.ndarray) -> None:
        self.df, self.column, self.n, self.total = df, column, n, total
        self.count, self.low, self.trace = 0, 0.0, 0.0
        start = np.random.default_rng(SEED).standard_normal(len(total))
        self.basis, self.diagonal, self.beside = [start / np.linalg.norm(start)], [], []

    def __call__(self, block: np.ndarray) -> np.ndarray:
        rides = len(self.basis) <= min(LANCZOS_STEPS, len(self.total)) and self.basis[-1] is not None
        cols = np.column_stack([block, self.basis[-1]]) if rides else block
        n, total = self.n, self.total

        def part(x):
            c = _centred(x, n, total)
            return np.append((c.T @ (c @ cols)).ravel(), np.einsum("ij,ij->", c, c))

        got = _summed(self.df, self.column, part, "double")
        flat = np.array([got[i] for i in range(len(got))])
        self.count, self.trace = self.count + 1, flat[-1] / n
        out = flat[:-1].reshape(cols.shape) / n
        if rides:
            self._lanczos(out[:, -1])
            out = out[:, :-1]
        return out

    def _lanczos(self, z: np.ndarray) -> None:
        basis = np.column_stack(self.basis)
        self.diagonal.append(float(self.basis[-1] @ z))
        for _ in range(2):
            z = z - basis @ (basis.T @ z)
        rest = float(np.linalg.norm(z))
        values, vectors = np.linalg.eigh(np.diag(self.diagonal) + np.diag(self.beside, 1) + np.diag(self.beside, -1))
        self.low = max(self.low, values[0] - rest * abs(vectors[-1, 0]))
        self.beside.append(rest)
        self.basis.append(z / rest if rest > 1e-10 * max(values[-1], 0) else None)


def _filtered(passes: _Passes, q: np.ndarray, vq: np.ndarray, values: np.ndarray, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance, times the block.

    It is at most 1 between the lower bound and the least Ritz value, and
    scaled to 1 at the largest; ``vq`` is the covariance times ``q``."""
    high = values[-1]
    low = min(passes.low, high * (1 - 1e-3))
    centre, half = (high + low) / 2, (high - low) / 2
    first = scale = half / (values[0] - centre)
    before, now = q, (vq - centre * q) * (first / half)
    for _ in range(2, degree + 1):
        nxt = 1 / (2 / first - scale)
        before, now = now, (passes(now) - centre * now) * (2 * nxt / half) - before * (scale * nxt)
        scale = nxt
    return now


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS, guard: int = GUARD,
        degree: int = DEGREE, tolerance: float = TOLERANCE) -> Whitener:
    """The leading eigenvectors of the vectors' covariance (divisor n)."""
    counts = _summed(df, column, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    if not counts:
        return Whitener(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    width, n = len(counts) - 1, counts[len(counts) - 1]
    total = np.array([counts[i] for i in range(width)], np.int64)
    passes = _Passes(df, column, n, total)
    size, wanted = min(width, components + guard), min(width, components)
    q = np.linalg.qr(np.random.default_rng(SEED + 1).standard_normal((width, size)))[0]
    vq, best, stalled = passes(q), np.inf, 0
    for _ in range(MAX_FILTERS):
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        worst = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max()
        if size == width or worst <= tolerance * values[0]:
            break
        stalled = stalled + 1 if worst > best / 2 else 0
        if stalled >= 3 and worst <= 1e-11 * values[0]:  # the sums' own rounding
            break
        best = min(best, worst)
        q = np.linalg.qr(_filtered(passes, q, vq, values, degree))[0]
        vq = passes(q)
    else:
        raise RuntimeError(f"residual {worst:g} after {passes.count} passes, above {tolerance:g} of {values[0]:g}")
    wanted = int((values[:wanted] > 1e-12 * values[0]).sum()) if values[0] > 0 else 0
    axes = q[:, :wanted]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(wanted)]) if wanted else np.ones(0)
    return Whitener(n, tuple(int(v) for v in total), axes * signs, values[:wanted], passes.trace, passes.count)


def identity_error(df: DataFrame, model: Whitener, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus I."""
    k = len(model.values)
    if not k:
        return 0.0
    n, total, projection = model.n, np.array(model.total, np.int64), model.projection

    def part(x):
        w = _centred(x, n, total) @ projection
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    got = _summed(df, column, part, "double")
    flat = np.array([got[i] for i in range(len(got))]) / n
    mean = flat[k * k:]
    return float(np.abs(flat[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """Sum over the dimensions of (n x - total)^2, exact."""
    whole = total // n
    step, rest = x - whole, total - n * whole
    most = (int(np.abs(step).max()) + 1) * n
    if most * most * x.shape[1] < 2 ** 63:
        return ((n * step - rest) ** 2).sum(axis=1)
    return np.array([sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest)) for row in step], dtype=object)


def transform(df: DataFrame, model: Whitener, column: str = "embedding") -> DataFrame:
    """The rows with a usable vector, with ``_whitened`` (array of double, one
    entry a component) and ``_deviation`` (long: the squared distance from the
    mean times n squared; beyond 2^63 - 1 an error)."""
    schema = T.StructType([*df.schema.fields, T.StructField(free(df, "_whitened"), T.ArrayType(T.DoubleType())),
                           T.StructField(free(df, "_deviation"), T.LongType())])
    at, names = df.columns.index(column), schema.names
    n, total, projection = model.n, np.array(model.total, np.int64), model.projection
    k = len(model.values)

    def work(batches):
        for batch in batches:
            rows, x = _integers(batch.column(at))
            if not len(rows):
                continue
            w = _centred(x, n, total) @ projection
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * k, k, dtype=np.int32) if k else np.zeros(len(rows) + 1, np.int32)), pa.array(w.ravel()))
            kept = batch.take(pa.array(rows))
            yield pa.record_batch([*kept.columns, lists, pa.array(_deviations(x, n, total).tolist(), pa.int64())], names=names)

    return df.mapInArrow(work, schema)


def whitened_rows(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    one row for each usable vector and component."""
    df = embeddings.select("vec_id", "embedding")
    model = fit(df, components=components)
    share = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    rows = transform(df, model).select("vec_id", "_deviation", F.posexplode("_whitened").alias("_at", "whitened"))
    return rows.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                       F.col("_deviation").alias("deviation"), "whitened", F.get(share, F.col("_at")).alias("explained"),
                       F.lit(identity_error(df, model)).alias("identity_error"))
