"""Embedding whitening: vectors projected on the eigenvectors of their covariance, each direction brought to variance one.

Method, mixed-precision refinement. Vectors become integers, x = floor(64 c) + 1000000, and each distinct x counts once.
Sums and centred second moments of x are added up by tasks: x is centred by the rounded mean first, so that products are
small integers and their sums exact in double precision while they stay below 2**53. The eigenvectors of that covariance,
found in float32, are corrected by Ogita and Aishima's iteration in extended precision, which needs only matrix products:
from R = I - X'X and S = X'AX it takes E with E_ij = (S_ij + l_j R_ij) / (l_j - l_i), or R_ij / 2 where two eigenvalues
are closer than the present error can tell, and goes on with X + XE. Eigenvectors of such a cluster are only known as a
subspace Y at first: the small problem Y'(A - mI)Y, shifted by the cluster's mean, is solved by itself, which separates
eigenvalues that differ by far less than float32 sees. The error squares in each round.

What meets in the driver is bounded by the dimension d alone: d sums and d * d products. The distinct vectors are
written to the shared folder and read once for the sums, once for the products and once to measure the identity error.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; so are vectors whose length
isn't the most frequent one among the distinct vectors (the longest of equally frequent ones). 64 c beyond +-2**62 counts
as that. Repeated rows and equal vectors are whitened alike and counted once in the fit. Directions without variance
can't be whitened and are left out: a table with a single distinct vector gives no rows, nor does an empty one.
`deviation` is exact, and null where it doesn't fit a long. Null vec_ids are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, table

SCALE, SHIFT = 64, 1_000_000
#: Largest absolute value of a scaled entry.
LARGEST = float(1 << 62)
COMPONENTS = 16
EXTENDED = np.longdouble
#: Vectors turned into matrices at a time.
BLOCK_ROWS = 8192


def integer_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x of every row whose vector is usable."""
    c = F.col(column).cast("array<double>")
    usable = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(F.greatest(F.least(v * float(SCALE), F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + SHIFT)
    return vectors.where(usable).select("vec_id", x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as a matrix; all vectors have one length."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(first, BLOCK_ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension the number of vectors and the sums of the upper and lower halves of x, which can't overflow."""
    rows, high, low = 0, 0, 0
    for _, x in _blocks(batches):
        rows, high, low = rows + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
    if rows:
        at = np.arange(len(high), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), rows)), pa.array(high), pa.array(low)], ["dim", "rows", "high", "low"])


def _products(center: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            d = (x - np.array(center, np.int64)).astype(float)
            total = d.T @ d if total is None else total + d.T @ d
        yield from _matrix_rows(total)

    return run


def _matrix_rows(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        values = pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), values], ["i", "row"])


def _added(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of the tasks' matrices."""
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((rows, columns))
    for i, j, v in cells.collect():  # rows * columns numbers
        out[i, j] = v
    return out


def _clusters(values: np.ndarray, width) -> list[np.ndarray]:
    """Numbers of values that lie within `width` of their neighbour in sorted order; single values are left out."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def refine(matrix: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix in extended precision, eigenvalues falling."""
    size = float(np.abs(matrix).max()) or 1.0
    a = np.asarray(matrix, EXTENDED) / EXTENDED(size)
    eye, tiny = np.eye(len(a), dtype=EXTENDED), np.finfo(EXTENDED).eps
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(EXTENDED)
    norm = np.sqrt((a * a).sum())
    floor = 16 * len(a) * tiny * norm  # eigenvalues closer than this count as one
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding is divided by small gaps and the columns lean
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        width = max(2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())), floor)
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > width
        change = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ change
        for part in _clusters(values, width):
            y = x[:, part]
            small = y.T @ (a @ y) - values[part].mean() * (y.T @ y)
            small = (small + small.T) / 2
            spread = np.abs(small).max()
            if spread > floor:
                x[:, part] = y @ np.linalg.eigh((small / spread).astype(float))[1].astype(EXTENDED)
        if np.abs(change).max() <= 8 * tiny:
            break
    x = x + x @ (eye - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(0))
    values = np.einsum("ij,ij->j", x, a @ x) * EXTENDED(size)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    lead = np.abs(x).argmax(0)
    return values[order], x * np.sign(x[lead, np.arange(x.shape[1])])


@dataclass
class Whitening:
    """What a vector is whitened with: counts and sums of the fit, components as rows, their variances, all in doubles."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dimension(self) -> int:
        return len(self.sums)

    @property
    def center(self) -> list[int]:
        """The mean of x, rounded."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times what rounding took from the mean."""
        return [s - self.n * c for s, c in zip(self.sums, self.center)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - np.array(self.center, np.int64)) - np.array([r / self.n for r in self.rest])
        return (centred @ self.components.T) / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)**2, as n**2 |d|**2 - 2 n d.r + |r|**2 with d = x - center and r = S - n center."""
        d, n = x - np.array(self.center, np.int64), self.n
        most = int(np.abs(d).max(initial=0))
        square = sum(r * r for r in self.rest)
        if (most + 1) ** 2 * n * n * self.dimension < 1 << 61:
            return (n * n * (d * d).sum(1) - 2 * n * (d @ np.array(self.rest, np.int64)) + square).tolist()
        exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, self.rest)) for row in d.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _identity_products(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            w = model.whitened(x)
            w = np.column_stack([w, np.ones(len(w))])
            total = w.T @ w if total is None else total + w.T @ w
        yield from _matrix_rows(total)

    return run


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x; None if no vector is usable."""
    distinct = materialize(integer_vectors(vectors, column).select("x").distinct(), "distinct-vectors")
    lengths = distinct.where("size(x) > 0").groupBy(F.size("x").alias("length")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if first is None:
        return None
    distinct = distinct.where(F.size("x") == first.length)
    parts = distinct.mapInArrow(_sums, "dim int, rows long, high long, low long")
    whole = parts.groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("rows", "high", "low")]).orderBy("dim").collect()
    model = Whitening(int(whole[0].rows), [(int(r.high) << 32) + int(r.low) for r in whole], np.empty(0), np.empty(0), 0.0)
    d = model.dimension
    moments = _added(distinct.mapInArrow(_products(model.center), "i int, row array<double>"), d, d)
    rest = np.array(model.rest, EXTENDED) / model.n
    covariance = np.asarray(moments, EXTENDED) / model.n - np.outer(rest, rest)
    values, x = refine(covariance)
    model.trace = float(np.trace(covariance))
    real = int((values[:components] > values[0] * d * 64 * np.finfo(EXTENDED).eps).sum()) if values[0] > 0 else 0
    model.components, model.variances = x[:, :real].T.astype(float), values[:real].astype(float)
    if real:
        sums = _added(distinct.mapInArrow(_identity_products(model), "i int, row array<double>"), real + 1, real + 1)
        mean = sums[:real, real] / model.n
        model.identity_error = float(np.abs(sums[:real, :real] / model.n - np.outer(mean, mean) - np.eye(real)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """vec_id, deviation and the whitened vector of every usable row, where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            columns = [part.column("vec_id"), pa.array(model.deviations(x), pa.int64()), pa.array(list(model.whitened(x)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    usable = integer_vectors(vectors, column).where(F.size("x") == model.dimension).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    return usable.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitened_components(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component."""
    model = fit_whitening(vectors, column, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    rows = whiten(vectors, model, column).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op11_whiten(spark, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))
