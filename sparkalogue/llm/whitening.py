"""Whitening of embeddings by spectral divide and conquer.

The covariance comes from exact integer sums over the distinct vectors. Its eigenvectors come
from polar decompositions: the orthogonal factor of the covariance less a shift is the matrix
sign, so half of it and the identity projects on the eigenvectors above the shift. Bases of
both parts split the matrix in two smaller ones, until one dimension (or a multiple of the
identity) is left. The polar factors are computed by dynamically weighted Halley steps on QR
factors (QDWH). Only matrices of the vectors' dimension reach the driver or are sent out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table

_EPS = np.finfo(float).eps
#: Sums of products of whole numbers below this are exact in double precision.
_EXACT = 2**53


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by QDWH."""
    k = len(a)
    x = a / (np.linalg.norm(a) or 1.0)
    # a lower bound of the smallest singular value; for a singular matrix rounding noise takes its place
    low = max(np.linalg.norm(np.linalg.solve(x, np.eye(k))) ** -1 if np.linalg.cond(x, 1) < 1 / _EPS else _EPS, _EPS)
    for _ in range(30):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        e = (1 + d) ** 0.5
        alpha = e + 0.5 * (8 - 4 * d + 8 * (2 - low**2) / (low**2 * e)) ** 0.5
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([gamma**0.5 * x, np.eye(k)]))
        new = beta / gamma * x + (alpha - beta / gamma) / gamma**0.5 * q[:k] @ q[k:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (alpha + beta * low**2) / (1 + gamma * low**2))
        if moved <= (4 * _EPS) ** (1 / 3) and abs(1 - low) <= 4 * _EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that span a projector's range: subspace iteration, which one step settles."""
    q, _ = np.linalg.qr(projector @ rng.standard_normal((len(projector), rank)))
    for _ in range(2):
        q, _ = np.linalg.qr(projector @ q)
    return q


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by spectral divide and conquer."""
    rng = np.random.default_rng(0)
    size = np.linalg.norm(v)
    values, vectors = [], []
    waiting = [((v + v.T) / 2, np.eye(len(v)))]
    while waiting:
        a, basis = waiting.pop()
        k = len(a)
        mean = np.trace(a) / k if k else 0.0
        apart = a - mean * np.eye(k)
        if k <= 1 or np.linalg.norm(apart) <= 4 * _EPS * size:
            values += np.diag(a).tolist()
            vectors.append(basis)
            continue
        # the middle of the diagonal parts the eigenvalues about evenly; the mean always has some on either side
        for shift in (np.median(np.diag(a)), mean, *(mean + np.linalg.norm(apart) * rng.uniform(-0.5, 0.5, 20))):
            projector = (polar(a - shift * np.eye(k)) + np.eye(k)) / 2
            rank = round(np.trace(projector))
            if not 0 < rank < k or np.linalg.norm(projector @ projector - projector) > 1e-10:
                continue
            q, _ = np.linalg.qr(np.hstack([_basis(projector, rank, rng), _basis(np.eye(k) - projector, k - rank, rng)]))
            turned = q.T @ a @ q
            if np.linalg.norm(turned[:rank, rank:]) <= 100 * k * _EPS * size:
                break
        else:
            raise ArithmeticError("no shift parts the eigenvalues")
        for part in (slice(0, rank), slice(rank, k)):
            waiting.append(((turned[part, part] + turned[part, part].T) / 2, basis @ q[:, part]))
    if not values:
        return np.zeros(0), np.zeros((0, 0))
    found, order = np.concatenate(vectors, axis=1), np.argsort(values)[::-1]
    found = found[:, order]
    return np.einsum("ij,ik,kj->j", found, v, found), found


def usable(vector: Column, scale: int) -> Column:
    """Neither null nor with entries that are null, not finite or beyond exact whole numbers; not empty."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float(_EXACT // scale)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def whole(vector: Column, scale: int, base: int) -> Column:
    """Entries as whole numbers: floor(scale * c) + base."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(base).cast("long"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64, copy=False)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y, exactly: in double precision where sums stay below 2**53, else in whole numbers of any size."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < _EXACT:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _exact_sum(y: np.ndarray) -> np.ndarray:
    wide = int(np.abs(y).max(initial=0)) * max(len(y), 1) >= 2**63
    return (y.astype(object) if wide else y).sum(axis=0).astype(object)


def _sums(vectors: DataFrame, dims: int, centre: list[int] | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows and exact sums of x; with a centre, of x - centre and of its products. Partial sums of each task meet by matrix place."""
    middle = np.array(centre or [0] * dims, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            y = _matrix(batch.column("x"), dims) - middle
            n += len(y)
            first = first + _exact_sum(y)
            second = second + _exact_products(y) if centre else second
        if n:
            places = [(0, 0, n), *((1, i, first[i]) for i in range(dims)), *((2 + i, j, second[i, j]) for i in range(dims if centre else 0) for j in range(i, dims))]
            yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "v": str(v)} for i, j, v in places], pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.string())]))

    totals = vectors.select("x").mapInArrow(run, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # at most dims * (dims + 3) / 2 + 1 rows
    n, first, second = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
    for i, j, v in totals:
        if i == 0:
            n = int(v)
        elif i == 1:
            first[j] = int(v)
        else:
            second[i - 2, j] = second[j, i - 2] = int(v)
    return n, first, second


class Whitening:
    """What fit() finds: n and sums of the fit list, components as columns, their eigenvalues and the trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        middle = [round(s / self.n) if abs(s) < _EXACT else s // self.n for s in self.sums]
        rest = np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, middle, strict=True)])
        return ((x - np.array(middle, np.int64)) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n * x - sum)**2; None where that doesn't fit a long."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        if most < 2**62:
            d = x * self.n - np.array(self.sums, np.int64)
            if (int(np.abs(d).max(initial=0)) ** 2) * x.shape[1] < 2**63:
                return (d * d).sum(axis=1).tolist()
        o = x.astype(object) * self.n - np.array(self.sums, object)
        return [s if s < 2**63 else None for s in (o * o).sum(axis=1).tolist()]


def fit(vectors: DataFrame, dims: int, most: int) -> Whitening | None:
    """Components of distinct rows x of whole numbers; None if they don't vary.

    Directions without variance (beyond rounding) are no components.
    """
    n, sums, _ = _sums(vectors, dims)
    if n < 2:
        return None
    centre = [int(s) // n for s in sums]
    _, first, second = _sums(vectors, dims, centre)
    v = np.array([[int(n * second[i, j] - first[i] * first[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    if not v.any():
        return None
    values, found = eigen(v)
    keep = values > 8 * dims * _EPS * np.trace(v)
    return Whitening(n, [int(s) for s in sums], values[keep][:most], found[:, keep][:, :most], float(np.trace(v)))


def identity_error(vectors: DataFrame, dims: int, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = fitted.project(_matrix(batch.column("x"), dims))
            total += np.vstack([z.T @ z, z.sum(axis=0)])
        yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "v": float(total[i, j])} for i in range(k + 1) for j in range(k)], pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))

    got = np.zeros((k + 1, k))
    for i, j, v in vectors.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():  # k * (k + 1) rows
        got[i, j] = v / fitted.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, most: int = 16, scale: int = 64, base: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries (or such that scale * c
    reaches 2**53) are left out, and so are those of another length than most have (ties: the
    shorter). A deviation that doesn't fit a long is null. Entries are taken as whole
    numbers floor(scale * c) + base; the components are fitted on each distinct vector once, so
    repeated rows and large groups of copies weigh nothing, and every row is answered. Null
    vec_ids stay null. Directions without variance are no components: an empty table, one
    distinct vector, or equal vectors give no rows. Equal eigenvalues leave the choice of their
    components open, but it is the same for all rows. Other columns are left out.
    """
    spark = embeddings.sparkSession
    good = embeddings.where(usable(F.col("embedding"), scale))
    rows = good.select("vec_id", whole(F.col("embedding"), scale, base).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = good.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes["dims"]
    rows = rows.where(F.size("x") == dims)
    distinct = write_table(rows.select("x").distinct(), "distinct-vectors")
    fitted = fit(distinct, dims, most)
    if fitted is None:
        return spark.createDataFrame([], schema)
    error, k = identity_error(distinct, dims, fitted), len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            rows = len(x)
            again = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()).take(again), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, fitted.n), pa.int64()), pa.array(fitted.deviations(x), pa.int64()).take(again),
                 pa.array(fitted.project(x).ravel()), pa.array(np.tile(fitted.explained, rows)), pa.array(np.full(rows * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
