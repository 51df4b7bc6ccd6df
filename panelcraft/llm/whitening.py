"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on the factor, projection of all rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .scratch import Scratch
from .words import lists, small

#: Entries become ``floor(SCALE * c) + OFFSET``.
SCALE, OFFSET = 64, 1_000_000
#: Entries whose whole number has this size or more count as non-finite.
LARGEST = float(1 << 60)
#: Components returned.
COMPONENTS = 16
#: Remaining part of a dimension's own variance that counts as rounding.
NEGLIGIBLE = 1e-13
#: Cosine of two columns below which they count as orthogonal, and most sweeps over all pairs.
ORTHOGONAL, SWEEPS = 1e-15, 60
#: Exact sums travel as digits of this many bits.
DIGIT, DIGITS = 31, 6


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and whole-number vectors of the rows without a null or non-finite entry."""
    for batch in small(batches):
        ids, found = [], []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not vector.is_valid or vector.values.null_count or not len(vector.values):
                continue
            x = np.floor(SCALE * vector.values.to_numpy(zero_copy_only=False)) + OFFSET
            if np.abs(x).max() < LARGEST:  # false for NaN too
                ids.append(vec_id)
                found.append(x.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(found, pa.int64())], names=["vec_id", "x"])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _digits(total: int) -> list[int]:
    """A whole number of any sign as digits whose weighted sum it is; the last digit has the sign."""
    out = [total >> DIGIT * k & (1 << DIGIT) - 1 for k in range(DIGITS - 1)]
    return [*out, total >> DIGIT * (DIGITS - 1)]


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` in whole numbers: by floating-point blocks where every sum is exact, else number by number."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < 1 << 53:
        return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _scatter(batches: Iterator[pa.RecordBatch], near: list[int]) -> Iterator[pa.RecordBatch]:
    """Sums of the centred entries (row -1) and of their products (rows 0, 1, ...) over the task's vectors."""
    d, centre = len(near), np.array(near, np.int64)
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for batch in small(batches):
        if batch.num_rows:
            y = matrix(batch.column(0)) - centre
            sums += y.astype(object).sum(axis=0)
            products += exact_products(y)
    upper = [(-1, j, s) for j, s in enumerate(sums)] + [(i, j, products[i, j]) for i in range(d) for j in range(i, d)]
    columns = list(zip(*((i, j, *_digits(int(s))) for i, j, s in upper), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "j", *(f"s{k}" for k in range(DIGITS))])


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor ``n``) of the vectors ``x``: entries centred at the nearest whole mean, multiplied, summed exactly.

    What the whole mean lacks is taken off in whole numbers too, so each entry is rounded once.
    """
    near = [(2 * s + n) // (2 * n) for s in sums]
    digits = [f"s{k}" for k in range(DIGITS)]
    rows = fit.select("x").mapInArrow(partial(_scatter, near=near), "i long, j long, " + ", ".join(f"{c} long" for c in digits))
    total = {(r["i"], r["j"]): sum(r[c] << DIGIT * k for k, c in enumerate(digits))
             for r in rows.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in digits)).collect()}
    d = len(sums)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = (n * total[i, j] - total[-1, i] * total[-1, j]) / (n * n)
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Columns ``l`` with ``l @ l.T`` equal to ``a``; triangular once rows are put in pivot order. Ends at the rank."""
    rest, columns = a.copy(), []
    while len(columns) < len(a):
        left = np.where(rest.diagonal() > NEGLIGIBLE * a.diagonal(), rest.diagonal(), 0.0)
        p = int(left.argmax())
        if left[p] <= 0:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0
        columns.append(column)
    return np.array(columns).T.reshape(len(a), len(columns))


def jacobi(factor: np.ndarray) -> np.ndarray:
    """Rotate the columns of a factor pairwise until all are orthogonal.

    A round treats disjoint pairs together; the rounds of a sweep meet every pair once, as in a tournament.
    """
    columns, width = factor.copy(), factor.shape[1]
    seats = list(range(width)) + [-1] * (width % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(a, b) for a, b in zip(seats[:half], seats[half:][::-1], strict=True) if a >= 0 and b >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = np.array([x[0] for x in pairs], int), np.array([x[1] for x in pairs], int)
            x, y = columns[:, p], columns[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > ORTHOGONAL
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            columns[:, p], columns[:, q] = c * (x - t * y), c * (t * x + y)
        if worst <= ORTHOGONAL * 8:
            return columns
    raise ArithmeticError("the rotations did not converge")


@dataclass
class Whitening:
    """What projects a vector: sizes and sums of the fit list, components (one per column) and their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, in whole numbers: of the machine where they fit, else of any size."""
        most = max(int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0) // self.n + 1)
        if 2 * most * self.n < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ (self.components / np.sqrt(self.eigenvalues))


def fit_whitening(fit: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """Components of the vectors ``x`` of a written table, each counted once; None if there is no vector.

    Sums and the matrix have as many entries as the dimension and its square, whatever the number of rows.
    """
    n = fit.count()
    if not n:
        return None
    sums = [int(r["s"]) for r in fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()]
    v = covariance(fit, n, sums)
    columns = jacobi(pivoted_cholesky(v))
    values = (columns * columns).sum(axis=0)
    order = np.argsort(-values, kind="stable")[:most]
    components = columns[:, order] / np.sqrt(values[order])
    return Whitening(n, sums, components, values[order], values[order] / v.trace() if len(order) else values[order])


def _moments(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    width = len(model.eigenvalues)
    sums, products = np.zeros(width), np.zeros((width, width))
    for batch in small(batches, 4096):
        if batch.num_rows:
            z = model.project(model.centred(matrix(batch.column(0))))
            sums += z.sum(axis=0)
            products += z.T @ z
    yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()]), pa.array([products.tobytes()])], names=["sums", "products"])


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity; one small row per task."""
    width = len(model.eigenvalues)
    sums, products = np.zeros(width), np.zeros((width, width))
    for r in fit.select("x").mapInArrow(partial(_moments, model=model), "sums binary, products binary").toLocalIterator():
        sums += np.frombuffer(bytes(r["sums"]))
        products += np.frombuffer(bytes(r["products"])).reshape(width, width)
    mean = sums / model.n
    return float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(width)).max(initial=0.0))


def _project(batches: Iterator[pa.RecordBatch], model: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    width = len(model.eigenvalues)
    for batch in small(batches):
        if not batch.num_rows or not width:
            continue
        centred = model.centred(matrix(batch.column(1)))
        d = centred.astype(object) if int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] >= 1 << 63 else centred
        deviation = [x if x < 1 << 63 else None for x in (d * d).sum(axis=1).tolist()]
        rows = len(deviation)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.repeat(np.arange(rows), width))), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
             pa.array(np.full(rows * width, model.n)), pa.array([x for x in deviation for _ in range(width)], pa.int64()),
             pa.array(model.project(centred).ravel()), pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * width, error))],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Project every vector on the leading components of the distinct vectors, scaled to unit variance.

    Returns ``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component;
    there are as many components as ``most`` and the rank of the covariance allow, so none if all vectors are equal
    and no row for an empty table. Rows whose vector is null, empty or holds a null or non-finite entry are dropped
    (an entry whose whole number reaches 2**60 counts as non-finite). Vectors of another length than the most
    frequent one (of ties the longer) are dropped too, since they have no covariance with the rest. Rows that repeat
    an id or a vector are projected one by one and fitted once; a null id stays null. ``deviation`` is null where it
    exceeds a long. Of equal eigenvalues any order may come. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = scratch.save(given.mapInArrow(_whole, "vec_id long, x array<long>"), "whole")
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is not None:
        whole = whole.where(F.size("x") == lengths["d"])
    fit = scratch.save(whole.select("x").distinct(), "fit")
    model = fit_whitening(fit, most)
    if model is None:
        model = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    error = identity_error(fit, model) if model.n else 0.0
    return whole.mapInArrow(partial(_project, model=model, error=error), "vec_id long, component int, n long, deviation long, "
                            "whitened double, explained double, identity_error double")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
