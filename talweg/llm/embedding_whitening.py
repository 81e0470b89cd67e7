"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V of the vectors is never formed. A pass over the rows computes X'(XQ) for a
block Q of ``BLOCK`` directions on centred rows, and Spark sums it: what reaches the driver is
one number for each dimension and direction, at any number of rows. On the driver the block
joins an orthonormal basis (QR), the problem is solved within it (Rayleigh-Ritz), and the next
block is the residuals of the leading pairs. Blocks of earlier passes stay in the basis, as
real spectra are flat: without them the rate would be a ratio of neighbouring eigenvalues.
Once the basis holds ``MOST`` directions it restarts from the leading pairs. The passes end
when each of the k residuals is at most ``TOLERANCE`` of the largest eigenvalue.

Entries c become the integer floor(1024 c) + 100000; sums of these are exact, and rows are
centred in integers before anything is multiplied.

Defined cases: rows with a null vector, an empty one, or a null or non-finite entry are
dropped; if lengths differ, the commonest length (the longest of those) counts and rows of
others are dropped; 1024 c beyond 2**40 either way counts as 2**40; null or repeated ids are
rows of their own; directions without variance are no components, so constant vectors, a
single row and an empty table give no rows; ``deviation`` is null where it passes a long;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
BLOCK = 16  # directions of a pass
MOST = 512  # directions of the basis, at which it restarts
TOLERANCE = 1e-13  # largest residual, as a share of the largest eigenvalue
PASSES = 400
PIECE = 1 << 20  # entries of a task's matrix at a time
SCALE, SHIFT, EXTREME = 1024, 100_000, float(1 << 40)


def fixed_point(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """(vec_id, x): the usable rows' vectors as longs."""
    x = F.col("x")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(EXTREME)), F.lit(-EXTREME))).cast("long") + SHIFT)
    return df.select(F.col(row_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where((F.size("x") > 0) & finite).select("vec_id", scaled.alias("x"))


def _matrices(batches, column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of the wanted length in pieces, with their matrix of longs."""
    for b in batches:
        for at in range(0, b.num_rows, step := max(1, PIECE // dims)):
            part = b.slice(at, step)
            lists = part.column(column)
            size = np.diff(lists.offsets.to_numpy())
            if not (size == dims).all():
                part = part.filter(pa.array(size == dims))
                lists = part.column(column)
            if part.num_rows:
                yield part, lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Centre:
    """Exact sums of the fit list, as quotient and rest by n, so that rows are centred in integers."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) squared, of each row."""
        d = x - self.whole
        most = (int(np.abs(d).max()) + 1) * self.n
        if most * most * d.shape[1] < 1 << 63:
            d = d * self.n - self.rest
            return (d * d).sum(axis=1).tolist()
        rest = self.rest.tolist()
        sums = (sum((v * self.n - r) ** 2 for v, r in zip(row, rest)) for row in d.tolist())
        return [s if s < 1 << 63 else None for s in sums]


def centre(rows: DataFrame) -> Centre | None:
    """Dimension, count and sums of rows (vec_id, x)."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    dims, n = lengths

    def sums(batches):
        total = [0] * dims
        for _, x in _matrices(batches, 0, dims):
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], ["i", "s"])

    got = rows.select("x").mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    s = {r.i: int(r.s) for r in got.collect()}  # one row a dimension
    return Centre(n, np.array([s[i] // n for i in range(dims)], np.int64), np.array([s[i] % n for i in range(dims)], np.int64))


def _summed(rows: DataFrame, dims: int, shape: tuple[int, int], piece) -> np.ndarray:
    """Sum over all rows of piece(x), a matrix of ``shape``; each task sends its own sum, and Spark adds these by cell."""
    cells = shape[0] * shape[1]

    def local(batches):
        total = np.zeros(shape)
        for _, x in _matrices(batches, 0, dims):
            total += piece(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int64()), pa.array(total.ravel())], ["cell", "v"])

    out = np.zeros(cells)
    for r in rows.select("x").mapInArrow(local, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.cell] = r.v
    return out.reshape(shape)


@dataclass
class Whitening:
    """What a fit gives: components in columns, by falling eigenvalue, and how it was reached."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    @property
    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """block made orthonormal, also to the basis; directions that vanish are replaced by random ones while there is room."""
    room = basis.shape[0] - basis.shape[1]
    block = block[:, : min(block.shape[1], room)].copy()
    for _ in range(3):
        size = np.linalg.norm(block, axis=0)
        block = np.where(size > 0, block / np.where(size > 0, size, 1), rng.standard_normal(block.shape))
        block -= basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        weak = np.abs(np.diag(r)) < 1e-8
        block = np.where(weak, rng.standard_normal(block.shape), q)
    block -= basis @ (basis.T @ block)
    return np.linalg.qr(block)[0]


def fit(rows: DataFrame, k: int = COMPONENTS, block: int = BLOCK, most: int = MOST, tolerance: float = TOLERANCE) -> Whitening | None:
    """The k leading components of rows (vec_id, x); None where there is no variance."""
    mid = centre(rows)
    if mid is None:
        return None
    dims, rng = len(mid.whole), np.random.default_rng(20)
    spark = rows.sparkSession

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q, and the trace of V."""
        sent = spark.sparkContext.broadcast((mid, q))

        def piece(x: np.ndarray) -> np.ndarray:
            at, q = sent.value
            c = at.centred(x)
            return np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), np.einsum("ij,ij->", c, c))])

        total = _summed(rows, dims, (dims + 1, q.shape[1]), piece) / mid.n
        sent.destroy()
        return total[:-1], float(total[-1, 0])

    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    new = _orthonormal(rng.standard_normal((dims, min(dims, max(block, k)))), basis, rng)
    for n_pass in range(1, PASSES + 1):
        made, trace = product(new)
        if trace <= 0:
            return None
        basis, image = np.hstack([basis, new]), np.hstack([image, made])
        small = basis.T @ image
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz, mapped = basis @ y, image @ y
        lead = min(k, len(values))
        residual = mapped - ritz * values
        size = np.linalg.norm(residual, axis=0)
        if (size[:lead] <= tolerance * values[0]).all() or basis.shape[1] == dims:
            break
        if basis.shape[1] + block > max(most, 2 * (k + block)):
            basis, image = np.linalg.qr(ritz[:, : k + block])[0], mapped[:, : k + block]
            image = mapped[:, : k + block] @ (ritz[:, : k + block].T @ basis)
        new = _orthonormal(residual[:, :block], basis, rng)
    else:
        raise ArithmeticError(f"residuals {size[:lead]} after {PASSES} passes; raise the block")
    keep = int((values[:lead] > dims * np.finfo(float).eps * values[0]).sum())
    return Whitening(mid, ritz[:, :keep], values[:keep], trace, size[:keep], n_pass)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k, dims = len(model.values), len(model.centre.whole)
    sent = rows.sparkSession.sparkContext.broadcast((model.centre, model.weights))

    def piece(x: np.ndarray) -> np.ndarray:
        mid, w = sent.value
        z = mid.centred(x) @ w
        return np.vstack([z.T @ z, z.sum(axis=0, keepdims=True)])

    total = _summed(rows, dims, (k + 1, k), piece) / model.centre.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """A row for each of rows (vec_id, x) and each component."""
    k, dims = len(model.values), len(model.centre.whole)
    sent = rows.sparkSession.sparkContext.broadcast((model.centre, model.weights, model.values / model.trace))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def whiten(batches):
        mid, w, share = sent.value
        for part, x in _matrices(batches, 1, dims):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, mid.n), pa.int64()),
                    pa.array(mid.deviations(x), pa.int64()).take(each),
                    pa.array((mid.centred(x) @ w).ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names,
            )

    return rows.mapInArrow(whiten, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every usable row of df."""
    rows = fixed_point(df, vector, row_id)
    model = fit(rows, k)
    if model is None:
        return rows.where("false").selectExpr("vec_id", "1 component", "1L n", "1L deviation", "1D whitened", "1D explained", "1D identity_error")
    return transform(rows, model, identity_error(rows, model))
