"""Whitening on the leading components of the covariance, found by LOBPCG over distributed block products."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._base import ship, stash
from lodestone.llm.vectors import matrix, scaled

#: Iterate vectors beyond those asked for; they widen the gap that sets the rate of convergence.
GUARD = 8
#: A component is certified when |V u - e u| is at most this share of the largest eigenvalue.
RESIDUAL, MAX_ROUNDS = 1e-12, 500
#: An eigenvalue of at most this share of the trace counts as zero: nothing can be whitened along its component.
ZERO = 1e-12

PARTIAL = "values array<double>"


def totalled(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all batches of of(rows as integers): one array per task, summed in about sqrt(tasks) tasks and then here."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            for i in range(0, len(x), 8192):
                total += of(x[i : i + 8192])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["values"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(math.prod(shape))
        for batch in batches:
            for one in batch.column("values"):
                total += one.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["values"])

    parts = rows.mapInArrow(part, PARTIAL)
    tasks = rows.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(merged, PARTIAL)
    return sum((np.array(r["values"]) for r in parts.collect()), np.zeros(math.prod(shape))).reshape(shape)


def orthonormal(columns: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of what the columns add to `against`; directions that rounding alone makes are left out."""
    size = np.linalg.norm(columns, axis=0)
    out = columns[:, size > 0] / size[size > 0]
    for _ in range(2):
        if against is not None:
            out = out - against @ (against.T @ out)
        if out.size:
            u, s, _ = np.linalg.svd(out, full_matrices=False)
            out = u[:, s > 1e-10]
    return out


def lobpcg(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric operator, the k largest, falling.

    Each round multiplies the operator once with an orthonormal basis of iterate, residual and previous direction, solves
    the small problem in that basis (Rayleigh-Ritz), and takes its leading vectors as the next iterate. It ends when the
    residuals of the k leading vectors, from a product made with these vectors themselves, are certified.
    """
    k = min(k, width)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, k + GUARD))))[0]
    before = np.zeros((width, 0))
    vx = product(x)
    for _ in range(MAX_ROUNDS):
        e, y = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        x, vx, e = x @ y[:, ::-1], vx @ y[:, ::-1], e[::-1]
        residual = vx - x * e
        if np.linalg.norm(residual[:, :k], axis=0).max() <= RESIDUAL * max(e[0], 0) or not vx.any():
            return e[:k], x[:, :k]
        new = orthonormal(np.hstack([residual, before]), x)
        basis = np.hstack([x, new])
        image = product(basis)
        small = basis.T @ image
        y = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, : x.shape[1]]
        before = new @ y[x.shape[1] :]
        x = np.linalg.qr(basis @ y)[0]
        vx = image @ (basis.T @ x)
    raise RuntimeError("residuals were not certified")


def whiten(rows: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and leading component.

    Components of vectors count as x = floor(scale * component). The fit list holds each distinct x once (an exchange that
    combines equal vectors before it sends them), as a table in the shared folder. Its size, sums and trace are exact
    integers. Covariances are over the fit list, centred first. `lobpcg` meets them only through products with blocks of at
    most 3 * (components + 8) columns: each task sums its centred rows times (centred rows times block) and sends one array.
    identity_error comes from a pass over the whitened fit list. Every row is then projected where it lies.

    Vectors that are null or hold null or non-finite entries are left out; shorter ones count as filled up with zeros.
    Repeated rows count once in the fit and each in the result. Components whose eigenvalue is zero (all vectors equal, or in
    a space of fewer dimensions) are left out, as nothing can be whitened along them; an empty table gives no rows.
    Components of equal eigenvalues are some orthonormal basis of their space. A deviation beyond the range of a long is
    null. Scaled entries of 2 ** 23 or more raise an error. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    ship(spark)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    ints = scaled(rows, scale, id_col, vector_col)
    fit = stash(ints.select("x").distinct(), "fit")
    about = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = about["n"], about["width"] or 0
    if not n or not width:
        return spark.createDataFrame([], kinds)

    def halves(x: np.ndarray) -> np.ndarray:  # sums of x and of the halves of its squares: whole numbers far below 2 ** 53 in a batch
        square = (x**2).sum(1)
        return np.concatenate([x.sum(0), [(square >> 20).sum(), (square & 0xFFFFF).sum()]]).astype(float)

    sums = exact_sums(fit, halves, width)
    total, squares = sums[:width], (sums[width] << 20) + sums[width + 1]
    trace = (n * squares - sum(s * s for s in total)) / n**2
    if trace <= 0:
        return spark.createDataFrame([], kinds)
    mean = np.array([s / n for s in total])

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return totalled(fit, of, width, block.shape) / n

    e, u = lobpcg(product, width, components)
    keep = e > ZERO * trace
    e, u = e[keep], u[:, keep]
    to = u / np.sqrt(e)
    centre = totalled(fit, lambda x: ((x - mean) @ to).sum(0), width, e.shape) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ to - centre
        return w.T @ w

    error = float(np.abs(totalled(fit, spread, width, (len(e), len(e))) / n - np.eye(len(e))).max()) if len(e) else 0.0
    explained, m, square_of_sums, sums_of = e / trace, len(e), sum(s * s for s in total), np.array(total, object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            far = n * n * (x**2).sum(1).astype(object) - 2 * n * (x.astype(object) @ sums_of) + square_of_sums
            far = pa.array([int(v) if v < 1 << 63 else None for v in far], pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)), far.take(each),
                pa.array(((x - mean) @ to).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return ints.mapInArrow(project, kinds)


def exact_sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int) -> list[int]:
    """Exact sums of the whole numbers that `of` gives for each batch, as integers of any size."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([of(matrix(batch.column("x"), width)).astype(np.int64)], pa.list_(pa.int64()))], ["values"])

    each = rows.mapInArrow(part, "values array<long>").select(F.posexplode("values").alias("at", "value"))
    found = each.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()
    return [int(r["v"]) for r in sorted(found, key=lambda r: r["at"])]
