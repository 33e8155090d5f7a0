"""Whitening of embeddings by cyclic Jacobi rotations.

Entries become integers, ``floor(scale * c)``, and each distinct vector counts once (the fit list). Executors count, sum exactly and gather the
centred scatter, one bounded row a task; the driver holds one ``d`` x ``d`` matrix, whatever the number of vectors, and applies symmetric Jacobi
rotations until every off-diagonal entry is negligible beside the two diagonal ones it couples, which keeps small eigenvalues accurate. The
whitening matrix, ``d`` x ``components``, is broadcast, and every row is projected. What the projection makes of the fit list is measured in one more pass.

Edge cases: vectors that are null or hold null or non-finite entries are dropped, and so are those whose length isn't the most frequent one (of lengths
as frequent, the longest one stays), as no covariance has them; a null id is kept as it is; rows alike are rows of their own and count once in the fit; extra columns are left out;
components without variance (fewer distinct vectors than components, constant dimensions) are not returned, as nothing can be divided by a deviation of zero, so one distinct vector and
an empty table give an empty result; equal eigenvalues keep the order in which the rotations leave them, the same for all rows; a deviation that is no
64-bit integer raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed

SCALE = 256
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Off-diagonal entries below this share of the geometric mean of their diagonal ones have vanished.
VANISHED = 1e-15
MOST_SWEEPS = 60
#: Eigenvalues below this share of the trace are none.
NO_VARIANCE = 1e-13
ROWS_AT_ONCE = 4096


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: the integer vectors of the rows that have one."""
    entries = F.col(vector_col).cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long"))
    rows = df.where(F.col(vector_col).isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") > 0)
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (size.d if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches, column: int):
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield _matrix(b.column(column).slice(at, ROWS_AT_ONCE))


def totals(fit: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors there are, and their exact sum."""

    def run(batches):
        n, total = 0, 0
        for x in _slices(batches, 0):
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "total": pa.array([total.tolist()], pa.list_(pa.int64()))})

    parts = fit.select("x").mapInArrow(run, "n long, total array<long>")
    rows = parts.select("n", F.posexplode("total").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # a row a dimension
    return (rows[0].n if rows else 0), np.array([r.s for r in rows], np.int64)


def scatter(fit: DataFrame, n: int, total: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """The covariance, divisor ``n``, of the vectors or of what ``project`` makes of them, each centred before it is multiplied; one matrix a task, summed in Spark."""
    mean = total / n

    def run(batches):
        held = None
        for x in _slices(batches, 0):
            c = x - mean
            c = c if project is None else c @ project
            held = c.T @ c if held is None else held + c.T @ c
        if held is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([held.ravel().tolist()], pa.list_(pa.float64()))})

    parts = fit.select("x").mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("i", "v"))
    rows = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # d * d numbers
    d = len(total) if project is None else project.shape[1]
    m = np.array([r.v for r in rows]).reshape(d, d) / n
    return (m + m.T) / 2


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic sweeps of plane rotations."""
    a, d = np.array(a, np.float64), len(a)
    v = np.eye(d)
    for _ in range(MOST_SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                g = a[p, q]
                if abs(g) <= VANISHED * np.sqrt(abs(a[p, p] * a[q, q])) or g == 0:
                    continue
                turned = True
                tau = (a[q, q] - a[p, p]) / (2 * g)
                t = np.copysign(1.0, tau) / (abs(tau) + np.hypot(1.0, tau))  # the smaller of the two angles
                c = 1 / np.hypot(1.0, t)
                s = t * c
                low, high, rp, rq = a[p, p] - t * g, a[q, q] + t * g, a[p].copy(), a[q].copy()
                a[p], a[q] = c * rp - s * rq, s * rp + c * rq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0.0, 0.0
                vp = v[:, p].copy()
                v[:, p], v[:, q] = c * vp - s * v[:, q], s * vp + c * v[:, q]
        if not turned:
            break
    else:
        raise RuntimeError("the rotations did not settle")
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """The exact sum of ``(n * x - total) ** 2`` over the dimensions, as longs."""
    bound = n * int(np.abs(x).max(initial=0)) + int(np.abs(total).max(initial=0))
    if bound**2 * x.shape[1] < 1 << 63:
        return ((n * x - total) ** 2).sum(axis=1)
    exact = ((x.astype(object) * n - total.astype(object)) ** 2).sum(axis=1)
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation is no 64-bit integer")
    return exact.astype(np.int64)


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``SCHEMA``, a row for each remaining row and component, numbered from 1 by falling eigenvalue."""
    spark = df.sparkSession
    rows = integers(df, id_col, vector_col)
    fit = checkpointed(rows.select("x").distinct())  # copies are merged before they are shuffled
    n, total = totals(fit)
    if n == 0:
        return spark.createDataFrame([], SCHEMA)
    covariance = scatter(fit, n, total)
    e, vectors = jacobi(covariance)
    trace = float(np.trace(covariance))
    k = min(components, int((e > NO_VARIANCE * max(trace, 1e-300)).sum()))
    if k == 0:
        return spark.createDataFrame([], SCHEMA)
    project = vectors[:, :k] / np.sqrt(e[:k])
    error = float(np.abs(scatter(fit, n, total, project) - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((project, total, n, e[:k] / trace, error))  # d x components numbers

    def run(batches):
        project, total, n, share, error = shared.value
        k = len(share)
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                x = _matrix(part.column(1))
                m = len(x)
                each = lambda column: column.take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": each(part.column(0)), "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), "n": pa.array(np.full(m * k, n, np.int64)),
                    "deviation": pa.array(np.repeat(deviations(x, n, total), k)), "whitened": pa.array(((x - total / n) @ project).ravel()),
                    "explained": pa.array(np.tile(share, m)), "identity_error": pa.array(np.full(m * k, error)),
                })

    return rows.mapInArrow(run, SCHEMA)
