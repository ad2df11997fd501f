"""Embedding whitening by matrix-free block subspace iteration.

Entries become whole numbers, so counts, sums and deviations are exact. The covariance V of the centred rows is never formed:
each pass over the rows computes XᵀXQ/n for an orthonormal block Q, a few columns wider than asked for. QR gives the next block,
Rayleigh-Ritz its eigenvalues; it ends when the residuals |Vq - eq| of all k pairs are within ``tolerance`` of the largest e, or no
longer fall because rounding is reached. A last pass measures the covariance of the whitened rows against the identity.

Tasks send a matrix of dimensions x block for all of their rows; these are summed by row of the matrix, so the driver receives one
matrix. A block that is as wide as the space (``block`` is at least ``SPARE`` times k, or the dimensions) is exact after one pass.

Rows whose vector is null, empty or holds a null or non-finite entry take no part, nor do those of another length than most (ties:
the shorter); repeated rows count as often as they stand; a null id is kept. Directions of no variance give no component, so equal
vectors, one row or none give no rows. Entries must stay within 2^40 after scaling, else the job fails. Signs are arbitrary, but the
same for all rows; equal eigenvalues have arbitrary axes in their plane. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimmer.llm.common import col, scratch, table

# Fixed by the contract: the scale of an entry and what is added to it.
SCALE, SHIFT = 64, 1_000_000
SPARE = 2  # columns of the block for each component asked for
MOST = 1 << 40


@dataclass
class Whitening:
    """What the fit found: n, exact sums by dimension, eigenvalues by falling size, unit axes as columns, trace of V."""

    n: int
    sums: np.ndarray  # of Python's whole numbers
    values: np.ndarray
    axes: np.ndarray
    trace: float
    residual: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the difference is taken in whole numbers while they are sure to fit."""
        mean = np.array([int(s) // self.n for s in self.sums], np.int64)
        rest = np.array([int(s) % self.n / self.n for s in self.sums])
        return (x - mean) - rest

    def white(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)


def whole(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): rows that take part, entries as longs."""
    v = col(embedding).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= MOST / SCALE))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(v.isNotNull() & (F.size(v) > 0) & finite)
    x = F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT)
    return kept.select(col(vec_id).alias("vec_id"), F.when(fine, x).otherwise(F.raise_error("an entry is too large to be scaled")).alias("x"))


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths, as rows of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _summed(rows: DataFrame, partial, width: int) -> dict[int, np.ndarray]:
    """The sum over all tasks of partial(x), matrices of ``width`` columns: {row of the matrix: its values}."""

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                part = partial(_matrix(b.column(0)))
                total = part if total is None else total + part
        if total is not None:
            r, c = total.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(r), c), pa.int32()), pa.array(np.tile(np.arange(c), r), pa.int32()), pa.array(total.ravel())], ["r", "c", "v"])

    found = rows.select("x").mapInArrow(run, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v")).toArrow()
    out: dict = {}
    for r, c, v in zip(*(found.column(k).to_pylist() for k in ("r", "c", "v"))):
        out.setdefault(r, np.zeros(width))[c] = v
    return out


def fit(rows: DataFrame, k: int = 32, block: int | None = None, tolerance: float = 1e-13, most_passes: int = 1000) -> Whitening | None:
    """Fits whole() rows of one length; None if there is nothing to whiten. Raises if the residuals don't come down in most_passes."""

    def sums(batches):
        import pyarrow as pa

        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["at", "v"])

    found = rows.select("x").mapInArrow(sums, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("at").collect()
    if not found:
        return None
    n, total = int(found[0].v), np.array([int(r.v) for r in found[1:]], object)
    d = len(total)
    width, k = min(d, block or max(SPARE * k, k + 8)), min(k, d)
    state = Whitening(n, total, np.ones(d), np.eye(d), 0.0, 0.0, 0)
    spread = _summed(rows, lambda x: (state.centred(x) ** 2).sum(axis=0)[None, :], d).get(0, np.zeros(d))
    trace = float(spread.sum() / n)
    if trace == 0:
        return None
    q = np.linalg.qr(np.random.default_rng(12).normal(size=(d, width)))[0]
    before = np.inf
    for passes in range(1, most_passes + 1):

        def product(x, q=q):
            c = state.centred(x)
            return c.T @ (c @ q)

        found = _summed(rows, product, width)
        z = np.stack([found.get(i, np.zeros(width)) for i in range(d)]) / n
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = q @ turn, z @ turn
        residual = float(np.linalg.norm(moved[:, :k] - ritz[:, :k] * values[:k], axis=0).max() / max(values[0], 1e-300))
        if residual <= tolerance or (residual <= 100 * tolerance and residual >= before):
            kept = int((values[:k] > values[0] * d * np.finfo(float).eps).sum())
            return Whitening(n, total, values[:kept], ritz[:, :kept], trace, residual, passes)
        before, q = residual, np.linalg.qr(moved)[0]
    raise ValueError(f"residual {residual:.3g} after {most_passes} passes; give a wider block")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, from a pass over all rows."""
    k = len(model.values)

    def moments(x):
        y = model.white(x)
        return np.vstack([y.T @ y, y.sum(axis=0)])

    found = _summed(rows, moments, k)
    second, mean = np.stack([found[i] for i in range(k)]) / model.n, found[k] / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of whole() rows; deviation as decimal(38,0), as it
    outgrows a long at some hundred million rows."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    k, share = len(model.values), model.values / model.trace

    def deviations(x):
        most = max(model.n * int(x.max()) - min(model.sums), max(model.sums) - model.n * int(x.min()))
        if most * most * x.shape[1] < 1 << 62 and max(map(abs, model.sums)) < 1 << 62:
            y = x * model.n - model.sums.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        return ((x.astype(object) * model.n - model.sums) ** 2).sum(axis=1).tolist()

    def run(batches):
        import decimal

        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, m = _matrix(part.column(1)), part.num_rows
                dev = [decimal.Decimal(v) for v in deviations(x)]
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), pa.array(dev, pa.decimal128(38, 0)).take(each),
                     pa.array(model.white(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 32, block: int | None = None, tolerance: float = 1e-13) -> DataFrame:
    """Fit on all rows that take part, then whitened() of each."""
    every = scratch(whole(rows, vec_id, embedding))
    lengths = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(2).collect()
    if len(lengths) > 1:
        every = every.where(F.size("x") == lengths[0].d)
    model = fit(every, k, block, tolerance) if lengths else None
    if model is None:
        return whitened(every.limit(0), Whitening(1, np.zeros(1, object), np.ones(1), np.eye(1), 1.0, 0.0, 0), 0.0)
    return whitened(every, model, identity_error(every, model))


def query(spark, sf_dir: str) -> DataFrame:
    """All embeddings, 32 components; the deviation as a long, which the cast checks."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
