"""Whitening of embeddings by shifted CholeskyQR: Gram passes over all rows, triangular factors on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curio.llm.common import column

SCALE, OFFSET = 64, 1_000_000
#: Rows of one block in a worker.
ROWS = 4096
#: Entries beyond this are as good as infinite: their longs would run over.
FAR = 2.0**55
#: Gram passes at most; three are enough for any condition number that doubles can hold.
PASSES = 6
#: A Gram matrix is the identity up to this; a direction with less than that is empty.
SETTLED, EMPTY = 1e-11, 1e-13
EPS = float(np.finfo(np.float64).eps)


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): rows whose vector is an array of at least one entry, all finite and not null (and not beyond 2^49)."""
    v = F.col(vector).cast("array<double>")
    # Entries as such, so that nothing but native aggregates runs here: NaN is greater than all numbers.
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= FAR / SCALE))
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col(key).alias("vec_id"), v.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in blocks with their longs x; rows of another length than size are left out."""
    for whole in batches:
        for begin in range(0, whole.num_rows, ROWS):
            batch = whole.slice(begin, ROWS)
            lengths = pc.list_value_length(column(batch, "v"))
            batch = batch.filter(pc.equal(lengths, size))
            if batch.num_rows:
                flat = column(batch, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                yield batch, np.floor(flat * SCALE).astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Center:
    """n rows of that size, and the exact sums of their longs."""

    n: int
    size: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is taken off in longs, so no digits are lost to the offset."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n*x - S)^2 over dimensions, exact; in Python's integers where longs might run over."""
        whole, rest = np.array([s // self.n for s in self.sums], dtype=np.int64), np.array([s % self.n for s in self.sums], dtype=object)
        near = x - whole
        if (float(np.abs(near).max()) + 1) ** 2 * float(self.n) ** 2 * self.size < 2.0**62:
            return ((near * self.n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return ((near.astype(object) * self.n - rest) ** 2).sum(axis=1).tolist()


def center(rows: DataFrame) -> Center | None:
    """Of rows (v): the commonest length (of equally common ones the longest), its rows and their sums. Partial sums
    are made in the tasks; what meets is a row for each task and dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for size in set(pc.list_value_length(column(batch, "v")).to_pylist()):
                for some, x in _blocks(iter([batch]), size):
                    n[size] = n.get(size, 0) + some.num_rows
                    sums[size] = [a + b for a, b in zip(sums.get(size, [0] * size), x.astype(object).sum(axis=0) if np.abs(x).max() > 2**50 else x.sum(axis=0).tolist(), strict=True)]
        for size, values in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n[size]] * size, pa.int64()), pa.array([str(int(v)) for v in values], pa.string())], ["size", "i", "n", "s"])

    parts = rows.select("v").mapInArrow(partial, "size int, i int, n long, s string")
    total = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).cache()
    try:
        best = total.where("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
        if best is None:
            return None
        sums = {r["i"]: int(r["s"]) for r in total.where(F.col("size") == best["size"]).collect()}  # a row for each dimension
    finally:
        total.unpersist()
    return Center(best["n"], best["size"], tuple(sums[i] for i in range(best["size"])))


def gram(rows: DataFrame, at: Center, turned: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the sums, the Gram matrix) of the turned centred rows. A task sums its own rows; Spark adds the tasks' entries,
    keyed by their place in the matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ones = None, None
        for _, x in _blocks(batches, at.size):
            q = turned(at.centred(x))
            total, ones = (q.T @ q, q.sum(axis=0)) if total is None else (total + q.T @ q, ones + q.sum(axis=0))
        if total is not None:
            width = len(ones)
            upper = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(width, -1), upper[0]]), pa.int32()), pa.array(np.concatenate([np.arange(width), upper[1]]), pa.int32()), pa.array(np.concatenate([ones, total[upper]]), pa.float64())], ["i", "j", "value"]
            )

    parts = rows.select("v").mapInArrow(partial, "i int, j int, value double")
    found = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # an entry of the matrix each
    width = max(r["j"] for r in found) + 1
    ones, out = np.zeros(width), np.zeros((width, width))
    for i, j, value in found:
        if i < 0:
            ones[j] = value
        else:
            out[i, j] = out[j, i] = value
    return ones, out


def cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper factor of g + shift; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, EPS * len(g) * max(float(np.trace(g)), np.finfo(np.float64).tiny))


def solved(upper: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular matrix, column after column."""
    out = np.empty_like(rows)
    for j in range(len(upper)):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


@dataclass(frozen=True)
class Whitening:
    """components (size by k, unit columns), their eigenvalues, the covariance's trace, and the largest difference of
    the whitened rows' covariance from the identity."""

    center: Center
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.components / np.sqrt(self.eigenvalues))


def fit(rows: DataFrame, most: int = 32) -> Whitening | None:
    """The whitening of rows (v), None without rows.

    The rows A, centred, are never held: each pass sums the Gram matrix of A R^-1 by triangular solves with the factors
    so far. The first Cholesky factor is of A'A plus a shift that makes it positive whatever the condition number; the
    next ones orthogonalise what that left, and R is their product. Once the Gram matrix is the identity, A = QR with
    orthonormal Q, and the SVD of R, size by size, has A's singular values and directions to double precision, which
    the eigenvectors of the covariance itself would not reach for small eigenvalues. Directions in which the rows do
    not vary (up to rounding) have no whitened values: there are as many components as the rows have rank, `most` at most.
    """
    at = center(rows)
    if at is None:
        return None
    steps: list[Callable[[np.ndarray], np.ndarray]] = []
    r, trace = np.eye(at.size), 0.0

    def turned(q: np.ndarray) -> np.ndarray:
        for step in steps:
            q = step(q)
        return q

    for k in range(PASSES):
        _, g = gram(rows, at, turned)
        if k == 0:
            trace = float(np.trace(g)) / at.n
            if trace == 0:
                return Whitening(at, np.zeros((at.size, 0)), np.zeros(0), 0.0, 0.0)
            # The bound of the shifted factorisation: 11 (n d + d (d + 1)) u |A|^2, held below the size of A itself.
            shift = min(11 * (at.n * at.size + at.size * (at.size + 1)) * EPS / 2, 1e-3) * float(np.linalg.norm(g, 2))
        else:
            shift = 0.0
            values, vectors = np.linalg.eigh(g)
            if (values < EMPTY).any():  # directions without rows go before a solve would blow up their rounding
                stay = vectors[:, values >= EMPTY]
                steps.append(lambda q, stay=stay: q @ stay)
                r, g, values = stay.T @ r, stay.T @ g @ stay, values[values >= EMPTY]
            if np.abs(values - 1).max() < SETTLED:
                break
        factor = cholesky(g, shift)
        steps.append(lambda q, factor=factor: solved(factor, q))
        r = factor @ r
    _, singular, turn = np.linalg.svd(r, full_matrices=False)
    count = min(most, len(singular))
    eigenvalues, components = singular[:count] ** 2 / at.n, turn[:count].T
    found = Whitening(at, components, eigenvalues, trace, 0.0)
    sums, g = gram(rows, at, found.whitened)
    covariance = g / at.n - np.outer(sums / at.n, sums / at.n)
    return Whitening(at, components, eigenvalues, trace, float(np.abs(covariance - np.eye(count)).max()))


def whiten(rows: DataFrame, fitted: Whitening | None) -> DataFrame:
    """(vec_id, deviation, whitened array) of rows (vec_id, v), in the fitted space; none where nothing was fitted."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, fitted.center.size):
            w = fitted.whitened(fitted.center.centred(x))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(np.ascontiguousarray(w).ravel()))
            exact = pa.array([str(d) for d in fitted.center.deviations(x)], pa.string()).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), exact, values], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(turned, schema)


def components(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 32) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error.

    The entries c become longs floor(64 * c) + 1000000. Vectors that are null or empty, or hold null or non-finite
    entries (or any of 2^49 and over, whose longs run over), are dropped, and so are vectors of another length than the
    commonest. Rows that repeat count as often as they are there, equal vectors get equal values. Where the rows have
    fewer than `most` dimensions, or vary in fewer, there are as many components. Signs are those of one SVD, the same
    for all rows. Equal eigenvalues have any orthonormal basis. deviation is null where it is no long. No rows in, or
    rows that are all equal: no rows out. Other columns are not read.
    """
    rows = usable(embeddings, vector, key)
    fitted = fit(rows, most)
    turned = whiten(rows, fitted)
    explained = [float(e) / fitted.trace for e in fitted.eigenvalues] if fitted else []
    each = turned.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.center.n if fitted else 0).cast("long").alias("n"), F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        F.get(F.array(*[F.lit(e) for e in explained]).cast("array<double>"), F.col("at")).alias("explained"), F.lit(fitted.identity_error if fitted else 0.0).alias("identity_error"),
    )
