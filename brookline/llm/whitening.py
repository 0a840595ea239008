"""PCA whitening of embeddings by LOBPCG.

The greatest eigenvectors of the vectors' covariance are found by locally optimal block preconditioned conjugate gradient,
without that matrix being made: a round multiplies the covariance with a block of directions in one pass over the
vectors, where each task centres its rows, multiplies them with the block and adds up one array of the block's size.
Rayleigh-Ritz on the iterate, its residuals and the previous directions gives the next iterate. Products of the parts of
the basis are carried along as linear combinations, so a round is one pass; they are made anew from the vectors before
an eigenpair counts as settled, and residuals that are not small enough then go on. BLOCK is wider than the wanted components,
as a pass over the vectors costs more than the products: what the block holds of the following eigenvectors lets the
wanted ones settle in few rounds. Driver and tasks hold dimension x (3 * BLOCK) numbers at most.

Vectors are brought to whole numbers (SCALE steps per unit), each distinct one counts once; sums are exact.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries are left out; of vectors of
several lengths the commonest length (of equally common ones the greatest) is the dimension, and others are left out too;
rows that repeat come out each; an empty table gives an empty one; directions without variance (eigenvalue at most TINY
of the trace) are no components, so equal vectors give no rows. Entries too great for a long are an error of Spark's
casts; a deviation too great for a decimal(38) cannot arise from them before n * x leaves 62 bits, which is an error too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SCALE, COMPONENTS, BLOCK, ROUNDS = 256, 4, 32, 200
#: A settled eigenpair's residual, and the least eigenvalue of a component, as shares of the greatest eigenvalue and of the trace.
RESIDUAL, TINY = 1e-13, 1e-12


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, x) with x an array of longs, of the rows whose vectors can be used."""
    v = F.col("v")
    real = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.coalesce(real, F.lit(False)))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).cast("array<bigint>").alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(fit: DataFrame, make: Callable[[np.ndarray], np.ndarray], n_rows: int) -> np.ndarray:
    """The sum over batches of the arrays of n_rows rows that make gives: one array per task, added up by Spark row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in slices(batches, 8192):
            part = make(_matrix(b.column(0)))
            total = part if total is None else total + part
        if total is not None:
            kind = pa.int64() if total.dtype.kind == "i" else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(kind))], ["i", "v"])

    kind = "bigint" if make(np.zeros((1, n_rows), np.int64)).dtype.kind == "i" else "double"
    parts = fit.select("x").mapInArrow(run, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "c"))
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("c").cast("decimal(38,0)") if kind == "bigint" else "c").alias("c")).collect()
    out = np.zeros((1 + max(r.i for r in rows), 1 + max(r.j for r in rows)), object if kind == "bigint" else float)
    for r in rows:
        out[r.i, r.j] = int(r.c) if kind == "bigint" else r.c
    return out


@dataclass
class Whitening:
    """n distinct vectors with sums `sums`; values and vectors (as columns) of the settled components, the trace, the largest
    residual as a share of the greatest eigenvalue, and the passes that it took."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def _independent(w: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Orthonormal columns of w's space, without what hardly differs from the rest."""
    size = np.sqrt((w * w).sum(0))
    u, s, _ = np.linalg.svd(w[:, size > 0] / size[size > 0], full_matrices=False)
    return u[:, s > least]


def lobpcg(times: Callable[[np.ndarray], np.ndarray], dimension: int, k: int, block: int = BLOCK, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The k greatest eigenvalues of a symmetric matrix given by its products with blocks, their vectors, the largest residual
    as a share of the greatest eigenvalue, and how many products it took. Raises if they do not settle."""
    block = min(dimension, max(block, k))
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, block)))[0]
    ax, calls = times(x), 1
    p = ap = np.zeros((dimension, 0))
    fresh = True
    for _ in range(rounds):
        values, u = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        u = u[:, ::-1]
        values, x, ax = values[::-1], x @ u, ax @ u
        r = ax - x * values[: x.shape[1]]
        size = np.sqrt((r * r).sum(0))
        worst = float(size[:k].max(initial=0.0))
        if worst <= RESIDUAL * max(values[0], 0.0):
            if fresh:
                return values[:k], x[:, :k], worst / values[0] if values[0] > 0 else 0.0, calls
            x = np.linalg.qr(x)[0]
            ax, fresh, calls = times(x), True, calls + 1
            continue
        # The residuals that matter, less what the iterate and directions hold of them, are multiplied; the rest is known.
        known, w = np.hstack([x, p]), r[:, size > RESIDUAL * max(values[0], 0.0) / 4]
        for _ in range(3):
            w = _independent(w - known @ (known.T @ w)) if w.shape[1] else w
        aw, calls = (times(w), calls + 1) if w.shape[1] else (w, calls)
        basis, product = np.hstack([known, w]), np.hstack([ax, ap, aw])
        inner = basis.T @ product
        u = np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1][:, :block]
        # Directions: what the new iterate takes from beyond the old one, made orthogonal to it within the basis, so that
        # neither they nor their products lose digits.
        step = u.copy()
        step[:block] = 0.0
        for _ in range(2):
            step = _independent(step - u @ (u.T @ step), 1e-8) if step.any() else step[:, :0]
        x, ax, p, ap = basis @ u, product @ u, basis @ step, product @ step
        fresh = False
    raise RuntimeError(f"the eigenvectors did not settle in {rounds} rounds")


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """The whitening of a table of whole vectors, which is read once per product; None without rows."""
    fit = written(vectors.select("x").distinct(), "fit")
    n = fit.count()
    if not n:
        return None
    sums = _summed(fit, lambda x: x.sum(0)[None, :], 1)[0]
    d, mean = len(sums), np.array([int(s) / n for s in sums])
    trace = float(_summed(fit, lambda x: ((x - mean[: x.shape[1]]) ** 2).sum(0)[None, :], 1).sum()) / n

    def times(w: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            centred = x - mean[: x.shape[1]]
            return centred.T @ (centred @ w[: x.shape[1]])

        return _summed(fit, product, 1) / n

    values, found, residual, passes = lobpcg(times, d, min(components, d), block)
    real = values > TINY * trace
    values, found = values[real], found[:, real]
    k = len(values)
    if not k:
        return Whitening(n, sums, values, found, trace, residual, 0.0, passes)
    scaled = found / np.sqrt(values)

    def gram(x: np.ndarray) -> np.ndarray:
        y = (x - mean[: x.shape[1]]) @ scaled[: x.shape[1]]
        return np.vstack([y.T @ y, y.sum(0)[None, :]])

    both = _summed(fit, gram, 1) / n
    off = np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max()
    return Whitening(n, sums, values, found, trace, residual, float(off), passes)


def squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """For each row the sum of (n * x - sums) ** 2, exactly."""
    if int(np.abs(x).max(initial=0)) * n + max(map(abs, map(int, sums)), default=0) >= 1 << 62:
        raise OverflowError("n * x leaves 62 bits")
    a = n * x - np.array([int(s) for s in sums], np.int64)
    high, low = a >> 31, a & ((1 << 31) - 1)
    if a.shape[1] and int(np.abs(a).max(initial=0)) < 1 << 28 and a.shape[1] < 128:
        return (a * a).sum(1).tolist()
    return [sum((h << 31 | b) ** 2 for h, b in zip(hs, bs, strict=True)) for hs, bs in zip(high.tolist(), low.tolist(), strict=True)]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, residual, passes), deviation as decimal."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, residual double, passes int"
    lengths = vectors.groupBy(F.size("x").alias("d")).count().sort(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("x") == lengths["d"])
    w = fit_whitening(vectors, components, block)
    assert w is not None
    scaled = w.vectors / np.sqrt(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, exact = scaled.shape[1], pa.decimal128(38, 0)
        for b in slices(batches, 8192):
            x = _matrix(b.column(1))
            deviation = pa.array(squares(x, w.n, w.sums), exact) if k else pa.array([], exact)
            y = ((w.n * x - np.array([int(s) for s in w.sums], np.int64)) / w.n) @ scaled
            again = pa.array(np.repeat(np.arange(b.num_rows), k))
            tile = lambda v, t: pa.array(np.tile(v, b.num_rows), t)  # noqa: E731, B023
            same = lambda v, t: pa.array(np.full(b.num_rows * k, v), t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(again), tile(np.arange(1, k + 1), pa.int32()), same(w.n, pa.int64()), deviation.take(again) if k else deviation, pa.array(y.ravel(), pa.float64()),
                 tile(w.values / w.trace if k else w.values, pa.float64()), same(w.identity_error, pa.float64()), same(w.residual, pa.float64()), same(w.passes, pa.int32())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual", "passes"],
            )

    return vectors.mapInArrow(run, schema)
