"""Embedding whitening by shifted CholeskyQR.

The centred rows are orthogonalised in passes: every pass sums the Gram matrix of the rows as they
stand after the triangular solves so far, adds a small shift, and its Cholesky factor becomes the next
triangular factor. The product of the factors is the R of the rows, whose singular vectors are the
components. Only matrices of the size of a vector squared reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
# Entries beyond are held here, so that all sums of a block are exact.
LARGEST = 2**53
# A first pass and two that repeat it bring rows of any condition number to double precision.
PASSES = 3
# Components whose share of the largest singular value is lower are rounding.
RANK = 1e-11
LIMB = 20
SLAB = 65_536


def shifted_vectors(embeddings: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): entries as floor(scale * c) + offset; unusable vectors are left out.

    Left out are null vectors and vectors with a null or non-finite entry. Entries beyond 2 ** 53
    count as that.
    """
    c = F.col("embedding").cast("array<double>")
    usable = F.coalesce(~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    held = lambda v: F.least(F.greatest(F.floor(v * scale), F.lit(-LARGEST)), F.lit(LARGEST))
    return embeddings.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda v: held(v) + offset).alias("x")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _from_centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where that holds them, else in Python's integers."""
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
    if max(n * largest, *map(abs, sums)) < 2**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_from_centre(x, n, sums) / n).astype(np.float64)


def _sum_rows(fit: DataFrame, schema: str, of_block, dim: int) -> list:
    """Sums over the fit list of matrices (i, j, value) that ``of_block`` makes of blocks of rows.

    Every task adds up its own blocks, Spark adds up the tasks' entries per (i, j); what is collected
    has one row per entry.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, SLAB):
                found = of_block(_matrix(batch.column(0).slice(start, SLAB), dim))
                total = found if total is None else total + found
        if total is not None:
            i, j = np.indices(total.shape)
            kind = pa.int64() if total.dtype == np.int64 else pa.float64()
            columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "value"])

    exact = F.col("value").cast("decimal(38,0)") if "long" in schema else F.col("value")
    return fit.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum(exact).alias("value")).collect()


def fit_sums(fit: DataFrame, dim: int) -> list[int]:
    """The exact sum of every dimension, from sums of high and low parts that never overflow."""
    rows = _sum_rows(
        fit, "i int, j int, value long",
        lambda x: np.stack([(x >> LIMB).sum(axis=0), (x & ((1 << LIMB) - 1)).sum(axis=0)]), dim,
    )
    found = {(r["i"], r["j"]): int(r["value"]) for r in rows}
    return [(found[0, j] << LIMB) + found[1, j] for j in range(dim)]


def _gram(fit: DataFrame, dim: int, of_rows) -> np.ndarray:
    """The Gram matrix of rows that ``of_rows`` makes of integer vectors."""
    def block(x: np.ndarray) -> np.ndarray:
        rows = of_rows(x)
        return rows.T @ rows

    found = _sum_rows(fit, "i int, j int, value double", block, dim)
    size = max(r["i"] for r in found) + 1
    out = np.empty((size, size))
    for r in found:
        out[r["i"], r["j"]] = r["value"]
    return (out + out.T) / 2


def solve_right(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of each upper triangular factor in turn, by back substitution in columns."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(len(r)):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def triangular_factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray | None:
    """R of the centred fit rows, by PASSES of shifted CholeskyQR; None where all rows are the mean."""
    dim = len(sums)
    factors: list[np.ndarray] = []
    for _ in range(PASSES):
        gram = _gram(fit, dim, lambda x: solve_right(_centred(x, n, sums), factors))
        norm = np.linalg.norm(gram, 2)
        if not norm > 0:
            return None
        # The least shift under which rounding leaves the matrix positive definite.
        shift = 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * norm
        if factors and np.linalg.eigvalsh(gram)[0] > 0.5:
            shift = 0.0
        factors.append(np.linalg.cholesky(gram + min(shift, norm / 100) * np.eye(dim)).T)
    whole = np.eye(dim)
    for r in factors:
        whole = r @ whole
    return whole


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``vectors`` is (vec_id, x array<long>). The fit list is each distinct x once; a vector shorter than
    the longest goes on as components of 0. All vectors are returned, those without an id and repeated
    ids too. Only components with a variance above rounding exist: fewer than the dimensions
    where vectors lie in a plane, none for a single distinct vector. No vectors, or none with a
    component, give no rows. ``deviation`` is null where it exceeds a long.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    dim = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    missing = F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(dim) - F.size("x"))
    vectors = vectors.withColumn("x", F.concat("x", missing))
    fit = stage(vectors.select("x").distinct(), "fit-vectors")
    n = fit.count()
    out = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    sums = fit_sums(fit, dim) if dim else []
    whole = triangular_factor(fit, n, sums) if dim else None
    if whole is None:
        return spark.createDataFrame([], out)
    _, sigma, rotation = np.linalg.svd(whole)
    rank = int((sigma > RANK * sigma[0]).sum())
    kept = min(components, rank)
    # Whitened rows are centred rows times this matrix; its size is that of a vector, squared at most.
    basis = rotation[:kept].T / (sigma[:kept] / np.sqrt(n))
    explained = (sigma**2 / (sigma**2).sum())[:kept]
    mean = _sum_rows(fit, "i int, j int, value double", lambda x: (_centred(x, n, sums) @ basis).sum(axis=0)[None, :], dim)
    mean = np.array([r["value"] for r in sorted(mean, key=lambda r: r["j"])]) / n
    covariance = _gram(fit, dim, lambda x: _centred(x, n, sums) @ basis - mean) / n
    error = float(np.abs(covariance - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            exact, rows = _from_centre(x, n, sums), len(x)
            if exact.dtype == np.int64 and int(np.abs(exact).max(initial=0)) ** 2 * dim < 2**63:
                deviation = (exact * exact).sum(axis=1).tolist()
            else:
                deviation = [total if total < 2**63 else None for total in (exact.astype(object) ** 2).sum(axis=1)]
            whitened = (exact / n).astype(np.float64) @ basis
            each = np.repeat(np.arange(rows), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1), rows), pa.int32()),
                    pa.array(np.full(rows * kept, n), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(whitened.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * kept, error)),
                ],
                names=[column.split()[0] for column in out.split(", ")],
            )

    return vectors.select("vec_id", "x").mapInArrow(run, out)
