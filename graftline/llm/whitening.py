"""Embedding whitening by a cyclic Jacobi eigenvalue iteration.

The distinct vectors are summed exactly as whole numbers; the scatter around their
mean is summed by tasks, which each pass on a triangle of numbers, and added up by
Spark.  The driver then holds one d x d matrix.  It applies symmetric Jacobi
rotations to all pairs of dimensions in turn until each off-diagonal entry is
negligible beside the *two diagonal entries it belongs to*; with this measure small
eigenvalues of a positive matrix come out as accurately as large ones, relative to
themselves.  The sorted whitening matrix, d x k numbers, goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stash import discard, stash
from . import text as tx

#: Rows of a batch in a task.
ROWS = 2048
EPS = float(np.finfo(np.float64).eps)


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors in columns) of a symmetric matrix by cyclic Jacobi rotations.

    A pair is left alone once its entry is below machine precision times the root of
    the product of its diagonal entries (or below the least part of the whole
    matrix, for diagonals that are zero).  Each vector's largest entry is positive.
    """
    a = np.array(matrix, dtype=np.float64)
    a = (a + a.T) / 2
    d = len(a)
    v = np.eye(d)
    floor = EPS * EPS * max(float(np.abs(a).max(initial=0.0)), np.finfo(np.float64).tiny)
    for _ in range(sweeps):
        turned = 0
        for p in range(d - 1):
            for q in range(p + 1, d):
                x = a[p, q]
                if abs(x) <= max(EPS * np.sqrt(abs(a[p, p] * a[q, q])), floor):
                    continue
                turned += 1
                tau = (a[q, q] - a[p, p]) / (2 * x)
                t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                app, aqq = a[p, p] - t * x, a[q, q] + t * x
                rows_p, rows_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q] = rows_p, rows_q
                a[:, p], a[:, q] = rows_p, rows_q
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                vp = c * v[:, p] - s * v[:, q]
                v[:, q] = s * v[:, p] + c * v[:, q]
                v[:, p] = vp
        if not turned:
            break
    else:
        raise RuntimeError("Jacobi rotations did not converge")
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    if d:
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return values[order], v


@dataclass(frozen=True)
class Whitening:
    """What a fit over n distinct vectors gives; ``sums`` are exact, ``vectors`` d x k with falling eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        """d x k: projects a centred vector to unit variance; a component without variance gives 0."""
        return self.vectors * np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1.0)), 0.0)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """(id, x array<long>): floor(scale * entry) + shift of each vector that is not null and all finite."""
    entries = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.col("c").isNotNull() & F.forall("c", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), entries.alias("c")).filter(good)
    return rows.select("id", F.transform("c", lambda e: F.floor(e * F.lit(scale)).cast("long") + F.lit(shift)).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], at: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, and their vectors (column ``at``) as a matrix of whole numbers."""
    for batch in tx.pieces(batches, ROWS):
        yield batch, batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S exactly: 64-bit where it fits, else Python's whole numbers."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums.tolist()), default=0)
    if most < 2**62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _add(held: np.ndarray | None, part: np.ndarray) -> np.ndarray:
    return part if held is None else held + part


def _triangle(fit: DataFrame, d: int, k: int, of) -> np.ndarray:
    """The k x k sum over the distinct vectors of the outer products of their rows under ``of``, which maps a block to an m x k matrix."""
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0, d):
            y = of(x)
            total = _add(total, (y.T @ y)[upper])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], names=["at", "value"])

    sums = fit.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((k, k))
    row, column = upper[0][sums["at"]], upper[1][sums["at"]]
    out[row, column] = out[column, row] = sums["value"]
    return out


def _sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """The number of distinct vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, 0, d):
            # Halves, so that a sum of a block can't leave 64 bits.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            at = np.arange(d + 1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(high, 0)), pa.array(np.append(low, batch.num_rows))], names=["at", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.select("x").mapInArrow(run, "at long, high long, low long").groupBy("at").agg(wide("high"), wide("low")).collect()
    found = {r["at"]: int(r["high"]) * 2**32 + int(r["low"]) for r in rows}
    return found.get(d, 0), tuple(found.get(j, 0) for j in range(d))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once; a vector that very many rows share leaves each task once."""
    return stash(rows.select("x").distinct(), "distinct_vectors")


def dimension(rows: DataFrame) -> int:
    """The length of most vectors (of the longer ones where that is a tie); 0 of an empty table."""
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return most["d"] if most else 0


def fit(distinct: DataFrame, d: int, components: int = 16) -> Whitening:
    """The leading components of the distinct vectors' covariance (divisor n)."""
    n, sums = _sums(distinct, d)
    if not n:
        return Whitening(0, (0,) * d, np.zeros(0), np.zeros((d, 0)), 0.0)
    exact = np.array(sums, dtype=object)
    centred = lambda x: (_deviations(x, n, exact) / n).astype(np.float64)
    covariance = _triangle(distinct, d, d, centred) / n
    values, vectors = jacobi(covariance)
    k = min(components, d)
    trace = float(np.trace(covariance))
    # What rounding leaves of a dimension without variance is none.
    values = np.where(values > 64 * d * EPS * max(values[0], 0.0), values, 0.0) if d else values
    return Whitening(n, sums, values[:k], vectors[:, :k], trace)


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened distinct vectors' covariance minus the identity, over components with variance."""
    real = np.flatnonzero(w.values > 0)
    if not len(real):
        return 0.0
    exact, matrix, n = np.array(w.sums, dtype=object), w.matrix[:, real], w.n
    white = lambda x: (_deviations(x, n, exact) / n).astype(np.float64) @ matrix
    # The rows are projections of centred vectors, so they are centred themselves.
    return float(np.abs(_triangle(distinct, len(w.sums), len(real), white) / n - np.eye(len(real))).max())


def whitened(rows: DataFrame, w: Whitening) -> DataFrame:
    """(id, deviation, white array<double>): each vector's exact squared deviation and its whitened components.

    ``deviation`` is null where it is no 64-bit number.
    """
    exact, matrix, n, d = np.array(w.sums, dtype=object), w.matrix, w.n, len(w.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, 1, d):
            off = _deviations(x, n, exact)
            if off.dtype == object or int(np.abs(off).max(initial=0)) ** 2 * d >= 2**63:
                square = [int(s) if s < 2**63 else None for s in (off.astype(object) ** 2).sum(axis=1)]
            else:
                square = (off * off).sum(axis=1)
            white = (off / n).astype(np.float64) @ matrix
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * matrix.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(square, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], names=["id", "deviation", "white"])

    return rows.select("id", "x").mapInArrow(run, "id long, deviation long, white array<double>")


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: (vec_id, component from 1, n, deviation, whitened, explained, identity_error).

    Vectors that are null, or hold a null, infinite or undefined entry, are left out,
    and so are those of another length than most (a tie: than the longer ones).
    Equal vectors are one in the fit and rows of their own in the result; so are
    rows that share an id or have none.  A component without variance has
    whitened 0 and counts in no error.  An empty table gives an empty one.  Other
    columns are not read.
    """
    rows = whole_numbers(tx.bounded(vectors), id_col, vector_col, scale, shift)
    d = dimension(rows)
    rows = rows.filter(F.size("x") == d)
    distinct = fit_list(rows)
    w = fit(distinct, d, components)
    error = identity_error(distinct, w)
    discard(distinct)
    part = F.posexplode(F.arrays_zip("white", F.array(*[F.lit(float(e)) for e in w.explained]).cast("array<double>").alias("explained"))).alias("at", "part")
    long = whitened(rows, w).select("id", "deviation", part)
    return long.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        F.col("part.white").alias("whitened"),
        F.col("part.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
