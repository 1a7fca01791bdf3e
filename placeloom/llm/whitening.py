"""Embedding whitening: principal axes of integer-scaled vectors by matrix-free block subspace iteration.

The covariance is never formed. Each Spark pass multiplies a thin block Q by it as Xᵀ(XQ) over centred rows; the driver sees
only the summed block, orthogonalises, solves the small Rayleigh-Ritz problem over the blocks so far and stops when the
residuals ‖Vq - eq‖ certify every wanted component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import Scratch

#: Entries are counted in 64ths, shifted by a million (fixed values); beyond +-10^12 they saturate, so that sums stay exact.
SCALE, SHIFT, WIDEST = 64, 1_000_000, 1e12


def finite(vector: str) -> Column:
    """Vectors that exist and hold numbers only."""
    return F.expr(f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")


def scaled(vector: str) -> Column:
    return F.expr(f"transform({vector}, c -> floor(greatest(-{WIDEST}D, least({WIDEST}D, {SCALE}D * cast(c AS double)))) + {SHIFT}L)")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def summed(fit: DataFrame, dim: int, kind: str, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``of(rows)`` over all rows of ``fit(x)``: every task adds up its own, Spark adds the tasks' sums entry by entry, and the driver
    gets ``size`` numbers however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch.column(0), dim)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(total.size), "v": total})

    out = np.zeros(size, dtype=np.int64 if kind == "long" else np.float64)
    for r in fit.select("x").mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


@dataclass
class Centre:
    """The mean as whole part and rest, so that rows are centred without losing digits."""

    n: int
    sums: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums // self.n).astype(np.float64) - (self.sums % self.n) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2; null beyond a long."""
        room = 2.0**62
        wide = self.n * float(np.abs(x).max(initial=0)) >= room or float(np.abs(self.sums).max(initial=0)) >= room
        d = self.n * x.astype(object) - self.sums.astype(object) if wide else self.n * x - self.sums
        if not wide and float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < room:
            return (d * d).sum(axis=1).tolist()
        total = (d.astype(object) ** 2).sum(axis=1)
        return [int(t) if t < 2**63 else None for t in total]


@dataclass
class Axes:
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of the columns outside the basis, orthonormalised; columns inside it vanish."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        new = q[:, np.abs(np.diag(r)) > 1e-10]
    return new - basis @ (basis.T @ new) if new.size else new


def principal_axes(fit: DataFrame, centre: Centre, k: int, extra: int = 8, tolerance: float = 1e-13, most_passes: int = 500, seed: int = 5) -> Axes:
    """The ``k`` largest eigenpairs of the covariance of ``fit(x)``, or as many as are above zero.

    A pass applies the covariance to one new block of k + ``extra`` columns. Rayleigh-Ritz runs over all blocks since the last
    restart, which has them converge as block Krylov spaces do; a restart keeps two blocks of the best Ritz vectors. The next
    block is the orthonormal part of the residuals. Ends when every residual is at most ``tolerance`` times the largest
    eigenvalue, or when the blocks span all dimensions, where Rayleigh-Ritz is exact.
    """
    dim, n = len(centre.sums), centre.n
    block = min(dim, k + extra)
    most = max(2 * block, min(dim, 8 * block))
    trace = float(summed(fit, dim, "double", lambda x: (centre(x) ** 2).sum(axis=0), dim).sum()) / n

    def applied(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ q)

        return summed(fit, dim, "double", of, q.size).reshape(q.shape) / n

    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, block)))[0]
    for passes in range(1, most_passes + 1):
        basis, image = np.hstack([basis, new]), np.hstack([image, applied(new)])
        small = basis.T @ image
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        lead = basis @ u[:, :block]
        left = image @ u[:, :block] - lead * e[:block]
        wanted = int((e[:k] > 1e-12 * max(trace, 0.0)).sum()) if trace > 0 else 0
        residual = np.linalg.norm(left[:, :k], axis=0).max(initial=0.0)
        if residual <= tolerance * max(e[0], 0.0):
            break
        new = orthonormal(left, basis)
        if not new.shape[1] or basis.shape[1] >= dim:
            break
        new = new[:, : dim - basis.shape[1]]
        if basis.shape[1] + new.shape[1] > most:
            basis, image = basis @ u[:, : 2 * block], image @ u[:, : 2 * block]
    else:
        raise ArithmeticError(f"residual {residual:.3g} after {most_passes} passes")
    vectors = np.linalg.qr(lead[:, :wanted])[0]
    vectors *= np.sign((vectors * lead[:, :wanted]).sum(axis=0))
    at = np.abs(vectors).argmax(axis=0)
    vectors *= np.sign(vectors[at, np.arange(wanted)])
    return Axes(e[:wanted], vectors, trace, float(residual), passes)


def whitened_vectors(spark: SparkSession, vectors: DataFrame, k: int = 16, extra: int = 8, tolerance: float = 1e-13) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(vec_id, component, n, deviation, whitened, explained, identity_error)``, one row per
    remaining row and component 1 to ``k``.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, as are those of another length than the most
    common (at a tie the longer). Each distinct scaled vector is fitted once, however often it is repeated; repeated rows and rows with a null
    id come back as often as they came. Components of zero variance are left out: fewer than ``k`` when fewer directions vary,
    none for one distinct vector. Equal eigenvalues leave the choice inside their space open. ``deviation`` beyond a long is
    null. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "whitening")
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(finite("embedding"))
    lengths = kept.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).head(1)
    if not lengths:
        return spark.createDataFrame([], out)
    dim = lengths[0]["dim"]
    rows = kept.where(F.size("embedding") == dim).select("vec_id", scaled("embedding").alias("x"))
    fit = scratch.write(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    n = fit.count()
    centre = Centre(n, summed(fit, dim, "long", lambda x: x.sum(axis=0), dim))
    axes = principal_axes(fit, centre, k, extra, tolerance)
    wanted = len(axes.values)
    if not wanted:
        return spark.createDataFrame([], out)
    root = np.sqrt(axes.values)

    def white(x: np.ndarray) -> np.ndarray:
        return centre(x) @ axes.vectors / root

    def moments(x: np.ndarray) -> np.ndarray:
        w = white(x)
        return np.vstack([w.sum(axis=0), w.T @ w])

    m = summed(fit, dim, "double", moments, (wanted + 1) * wanted).reshape(wanted + 1, wanted) / n
    error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(wanted)).max())
    explained = axes.values / axes.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), dim)
            many = len(x) * wanted
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), wanted))),
                    "component": np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(x)),
                    "n": np.full(many, n),
                    "deviation": pa.array(centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), wanted))),
                    "whitened": white(x).ravel(),
                    "explained": np.tile(explained, len(x)),
                    "identity_error": np.full(many, error),
                }
            )

    result = rows.mapInArrow(run, out)
    scratch.keep()
    return result
