"""Embedding whitening: scaled whole numbers, covariance of the distinct vectors, leading components, projection.

Each stored number c becomes the long floor(64 c) + 1000000, so sums are exact whatever the order. Tasks multiply their own
centred rows; the partial matrices, as wide as a vector, are added row by row. The driver solves the matrix and broadcasts
the components (16 x width numbers), which tasks apply to their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patronage.llm.linking import share
from patronage.llm.symmetric_eigen import leading_eigenpairs
from patronage.session import pin

SCALE, SHIFT = 64, 1_000_000
#: Groups in which the rows of the tasks' matrices are added first.
GROUPS = 64
#: Rows of a matrix product.
ROWS = 4096
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: n and sums S of x, components as columns with their eigenvalues, trace and the check's error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def used(self) -> np.ndarray:
        """Components with a variance above what rounding leaves of none."""
        return self.values > len(self.sums) * np.finfo(np.float64).eps * max(self.trace, 0.0)

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs, or Python's whole numbers where longs do not reach."""
        most = max(int(np.max(x, initial=0)), -int(np.min(x, initial=0)), *map(abs, self.sums), 1)
        kind = np.int64 if 2 * most * max(self.n, 1) < 1 << 62 else object
        return self.n * x.astype(kind) - np.array(self.sums, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.differences(x).astype(np.float64) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN where a component has no variance."""
        scale = np.where(self.used, np.sqrt(np.where(self.used, self.values, 1.0)), np.nan)
        return self.centred(x) @ self.vectors / scale


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows whose vector has no null, NaN, infinite or too large entry, and the width that most of them have."""
    # a product beyond the longs cannot be kept whole
    c = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("_c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < (1 << 62) / SCALE)) & (F.size("_c") > 0)
    x = F.transform("_c", lambda v: F.floor(v * SCALE).cast("long") + SHIFT)
    rows = pin(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("_c")).where(F.col("_c").isNotNull() & sound).select("vec_id", x.alias("x"))
    )
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("width")).first()
    return rows.where(F.size("x") == (widths["width"] if widths else 0))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centred_products(fit: DataFrame, width: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of r r^T, with r the ``width`` numbers that ``rows_of`` makes of x, already centred.

    Each task adds its rows' products; its matrix leaves it row by row, is added in groups of tasks, and then as a whole.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, seen = np.zeros((width, width)), False
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                r = rows_of(matrix_of(batch.column("x").slice(start, ROWS)))
                total += r.T @ r
                seen = True
        if seen:
            task = pa.array(np.full(width, TaskContext.get().partitionId() % GROUPS, dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(width + 1) * width, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([task, pa.array(np.arange(width, dtype=np.int32)), lists], ["part", "place", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total = matrix_of(group.column("sums").combine_chunks()).sum(axis=0)
        head = group.slice(0, 1)
        return head.set_column(head.schema.get_field_index("sums"), "sums", pa.array([total.tolist()], pa.list_(pa.float64())))

    schema = "part int, place int, sums array<double>"
    partial = fit.select("x").mapInArrow(products, schema).groupBy("part", "place").applyInArrow(added, schema)
    whole = partial.groupBy("place").applyInArrow(added, schema).toArrow()
    out = np.zeros((width, width))
    if whole.num_rows:
        out[whole.column("place").to_numpy()] = matrix_of(whole.column("sums").combine_chunks())
    return out


def _sums_of(fit: DataFrame, width: int, rows_of: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sums of the ``width`` numbers that ``rows_of`` makes of x, of the Spark type ``kind``: one row of sums a batch."""
    inner = pa.int64() if kind == "long" else pa.float64()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                total = rows_of(matrix_of(batch.column("x"))).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(inner))], ["s"])

    found = fit.select("x").mapInArrow(sums, f"s array<{kind}>").select(F.posexplode("s").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("s"))
    out = [0] * width
    for r in found.collect():
        out[r["place"]] = r["s"]
    return out


def fit_whitening(x: DataFrame, components: int = 16) -> Whitening | None:
    """Fits the distinct vectors of (x); nothing for an empty table."""
    # copies fold in their task before the shuffle, however often a vector occurs
    fit = pin(x.select("x").groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"))
    n = fit.count()
    if not n:
        return None
    width = len(fit.first()["x"])
    # halves of the longs, whose sums are longs
    halves = _sums_of(fit, 2 * width, lambda m: np.hstack((m >> 32, m & 0xFFFFFFFF)), "long")
    sums = [(high << 32) + low for high, low in zip(halves[:width], halves[width:], strict=True)]
    start = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0, None)
    covariance = centred_products(fit, width, start.centred) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading_eigenpairs(covariance, components)
    solved = Whitening(n, sums, values, vectors, float(np.trace(covariance)), None)
    live = np.flatnonzero(solved.used)
    if not len(live):
        return solved
    # the check reads the fit list again: mean of the whitened rows, then their centred products
    mean = np.array(_sums_of(fit, len(live), lambda m: solved.project(m)[:, live], "double")) / n
    error = centred_products(fit, len(live), lambda m: solved.project(m)[:, live] - mean) / n - np.eye(len(live))
    return Whitening(n, sums, values, vectors, solved.trace, float(np.max(np.abs(error))))


def _deviations(model: Whitening, x: np.ndarray) -> pa.Array:
    """sum (n x - S)^2 of each row, exact; null where it is no long."""
    d = model.differences(x)
    if d.dtype != object and float(np.max(np.abs(d), initial=0)) ** 2 * x.shape[1] < 2.0**62:
        return pa.array((d * d).sum(axis=1))
    exact = [sum(v * v for v in row) for row in d.astype(object).tolist()]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every kept row of (vec_id, embedding, ...).

    Rows whose vector is null or empty, or holds a null, NaN, infinite entry or one of 2^56 or more, are left out, and so
    are rows of another width than most have. Equal vectors count once in the fit, and rows may repeat or lack an id.
    Components are numbered from 1 by falling eigenvalue, as many as the vectors are wide, ``components`` at most. A
    component without variance has a null ``whitened``; without any variance ``explained`` and ``identity_error`` are null,
    too. ``deviation`` is null where it exceeds a long. An empty table gives an empty result.
    """
    x = scaled(vectors)
    model = fit_whitening(x, components)
    if model is None:
        return x.sparkSession.createDataFrame([], RESULT)
    shared = share(vectors.sparkSession, model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        explained = m.values / m.trace if m.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = matrix_of(part.column("x"))
                each = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(each), m.n)), _deviations(m, rows).take(pa.array(each)),
                        pa.array(m.project(rows).ravel(), from_pandas=True), pa.array(np.tile(explained, len(rows)), from_pandas=True),
                        pa.array([m.identity_error] * len(each), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(project, RESULT)
