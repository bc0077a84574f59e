"""Whitening of vectors by shifted CholeskyQR over all of them.

The centred vectors are the rows of a tall matrix A that is never gathered. A pass over the table sums the
Gram matrix of the rows; its Cholesky factor R (of the Gram matrix plus a small shift, where it is badly
conditioned) gives rows A R^-1 by triangular solves, which the next pass starts from; when they are
orthonormal the product of the factors is the R of a QR factorisation of A, and its singular values and
right vectors are those of A. So the condition of the Gram matrix, the square of A's, does no harm. The
driver sees sums of one row of numbers per dimension, whatever the number of vectors.

Entries c are turned into whole numbers floor(64 c) + 1000000 first, sums of which are exact; a row is centred
as (n x - S) / n, exact up to the division.

Vectors that are null or hold null or non-finite entries give no rows and count nowhere, nor do vectors of
another length than most (of equal counts, the greater length). Ids are carried along, be they null or
repeated; repeated vectors count each. A component whose standard deviation is below 1e-10 of the first's has no
direction in these data and is left out, so a table of n vectors has n - 1 components at most; without vectors there
are no rows. ``deviation`` must fit a long (n up to some ten million); beyond that the job ends with an
arithmetic error rather than a wrong number. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import stage

SLICE = 2048  # vectors handled at once
NO_DIRECTION = 1e-10
PASSES = 8
Transform = Callable[[np.ndarray], np.ndarray]


@dataclass
class Whitening:
    """Mean as sums over ``n`` vectors; components in columns, with their eigenvalues and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def apply(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.components / np.sqrt(self.eigenvalues))


def finite_vectors(vectors: DataFrame, vec_col: str) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    return F.coalesce(F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def whole_numbers(vectors: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """(vec_id, x) of the vectors that count, staged."""
    x = F.transform(vec_col, lambda c: F.floor(c.cast("double") * 64) + 1000000)
    rows = vectors.where(finite_vectors(vectors, vec_col)).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("many"))
    usual = sizes.orderBy(F.desc("many"), F.desc("d")).first()
    return stage(rows.where(F.size("x") == (usual.d if usual else 0)))


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def _table(rows: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray], d: int) -> np.ndarray:
    """Sum over all tasks of the matrix each makes of its vectors; only sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(m for _, m in _matrices(batches, d))
        i, j = np.indices(found.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(found.ravel(), pa.float64())], names=["i", "j", "value"])

    cells = rows.select("x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    got = cells.toPandas()
    out = np.zeros((int(got.i.max()) + 1, int(got.j.max()) + 1)) if len(got) else np.zeros((0, 0))
    out[got.i, got.j] = got.value
    return out


def gram(rows: DataFrame, change: Transform, d: int, k: int) -> np.ndarray:
    """Sum of q q^T over all changed rows."""
    def part(parts: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((k, k))
        for x in parts:
            q = change(x)
            out += q.T @ q
        return out

    return _table(rows, part, d)


def total(rows: DataFrame, change: Transform, d: int, k: int) -> np.ndarray:
    def part(parts: Iterator[np.ndarray]) -> np.ndarray:
        return sum((change(x).sum(axis=0) for x in parts), np.zeros(k))[None, :]

    return _table(rows, part, d)[0]


def centre(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (x * n - sums) / n


def solve_rows(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 for upper triangular R, column by column."""
    out = np.empty_like(rows)
    for j in range(r.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def shifted_cholesky(g: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """Upper factor of ``g``, with the least shift that keeps rounding from making it indefinite."""
    d = len(g)
    if shift:
        g = g + np.eye(d) * (11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.linalg.norm(g, 2), 1e-300))
    return np.linalg.cholesky(g).T


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of all vectors of ``rows`` (x); None without any."""
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = sizes.n, sizes.d
    if not n or not d:
        return None
    exact = rows.agg(*[F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(d)]).first()
    sums = np.array(list(exact), dtype=np.int64)
    factors: list[np.ndarray] = []

    def reduced(x: np.ndarray) -> np.ndarray:
        q = centre(x, n, sums)
        for r in factors:
            q = solve_rows(q, r)
        return q

    whole = np.eye(d)
    for _ in range(PASSES):
        g = gram(rows, reduced, d, d)
        values = np.linalg.eigvalsh(g)
        # directions the data do not have stay near 0, all others come to 1
        if factors and np.all((np.abs(values - 1) < 1e-12) | (values < 1e-12)):
            break
        r = shifted_cholesky(g, n, shift=not factors or values[0] < 0.5)
        factors.append(r)
        whole = r @ whole
    _, s, vt = np.linalg.svd(whole)
    kept = s > s[0] * NO_DIRECTION
    vt = vt[kept]
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    return Whitening(n, sums, (vt * sign[:, None]).T, s[kept] ** 2 / n, float((s ** 2).sum() / n))


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured in two passes over all rows."""
    d, k = w.components.shape
    mean = total(rows, lambda x: w.apply(centre(x, w.n, w.sums)), d, k) / w.n
    cov = gram(rows, lambda x: w.apply(centre(x, w.n, w.sums)) - mean, d, k) / w.n
    return float(np.abs(cov - np.eye(k)).max()) if k else 0.0


ROWS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
        "eigenvalue double")


def whiten(vectors: DataFrame, components: int = 32, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component (``ROWS``), components numbered from 1 by falling eigenvalue.

    ``deviation``: sum over dimensions of (n x - S)^2; ``explained``: eigenvalue over trace; the component with
    the greatest entry positive gives the sign.
    """
    rows = whole_numbers(vectors, vec_col, id_col)
    w = fit(rows)
    if w is None or not len(w.eigenvalues):
        return rows.sparkSession.createDataFrame([], ROWS)
    d = len(w.sums)
    k = min(components, len(w.eigenvalues))
    w.components, w.eigenvalues = w.components[:, :k], w.eigenvalues[:k]
    error = identity_error(rows, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, d):
            m = len(x)
            off = x * w.n - w.sums
            if m and (off.astype(float) ** 2).sum(axis=1).max() >= 2.0 ** 63:
                raise ArithmeticError("deviation does not fit a long")
            columns = [np.tile(np.arange(1, k + 1), m), np.full(m * k, w.n), np.repeat((off * off).sum(axis=1), k),
                       w.apply(off / w.n).ravel(), np.tile(w.eigenvalues / w.trace, m), np.full(m * k, error), np.tile(w.eigenvalues, m)]
            ids = part.column(part.schema.get_field_index("vec_id")).cast(pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                                             names=[c.split()[0] for c in ROWS.split(", ")])

    return rows.mapInArrow(run, ROWS)
