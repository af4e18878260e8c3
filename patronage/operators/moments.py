"""Sums of products over row blocks, and what follows from them: rank correlations, least squares, logistic regression.

Every task adds its own rows' products; only these small sums, as many as pairs of columns, travel. Columns are centred and
scaled before they are multiplied, so that sums of large numbers do not cancel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patronage.functions.numeric import finite

#: Newton stops when no weight moves by more than this part of the largest one.
SETTLED = 1e-12
MOST_ROUNDS = 25


def block_sums(df: DataFrame, columns: Sequence[str], make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of the ``size`` numbers that ``make`` adds up for a block of rows (columns as doubles, null as NaN)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                block = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
                total += make(block)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    sums = df.select(*columns).mapInArrow(add, "s array<double>").select(F.posexplode("s").alias("place", "v"))
    out = np.zeros(size)
    for r in sums.groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[r["place"]] = r["v"]
    return out


@dataclass(frozen=True)
class Scales:
    """Complete rows: their number, and mean and population deviation of each column."""

    n: int
    mean: np.ndarray
    std: np.ndarray

    def scaled(self, block: np.ndarray) -> np.ndarray:
        """Zero mean and unit deviation; a constant column becomes zero."""
        return (block - self.mean) / np.where(self.std > 0, self.std, 1.0)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as finite doubles, rows with a null left out."""
    return df.select(*[finite(c).alias(c) for c in columns]).dropna()


def scales(rows: DataFrame, columns: Sequence[str]) -> Scales:
    found = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    k = len(columns)
    mean, std = (np.array([v if v is not None else 0.0 for v in part], dtype=float) for part in (found[1:k + 1], found[k + 1:]))
    # the deviation of a constant column is what rounding leaves of zero
    return Scales(found[0], mean, np.where(std > 1e-12 * np.maximum(np.abs(mean), 1e-300), std, 0.0))


def rank_correlations(df: DataFrame, tables: Sequence[tuple[np.ndarray, np.ndarray]], columns: Sequence[str]) -> np.ndarray:
    """Correlations of the columns' ranks; a table holds a column's values in order and their average ranks less the mean rank.

    Rows are read once: each task looks its values up and multiplies the ranks. A null has no rank and adds nothing;
    two columns are only comparable if their nulls lie in the same rows.
    """
    k = len(columns)
    # as many numbers as the caller's bound on the tables allows; ranks are centred already
    shared = df.sparkSession.sparkContext.broadcast(list(tables))

    def products(block: np.ndarray) -> np.ndarray:
        ranks = np.zeros_like(block)
        for j, (values, centred) in enumerate(shared.value):
            here = ~np.isnan(block[:, j])
            if len(values):
                ranks[here, j] = centred[np.searchsorted(values, block[here, j])]
        return (ranks.T @ ranks).ravel()

    sums = block_sums(df, columns, products, k * k).reshape(k, k)
    spread = np.sqrt(np.diag(sums))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.outer(spread, spread) > 0, sums / np.outer(spread, spread), np.nan)


@dataclass(frozen=True)
class Fit:
    """Weights with the intercept first, their standard errors, and the degrees of freedom that are left."""

    weights: np.ndarray
    errors: np.ndarray
    dof: int
    r_squared: float | None = None
    rounds: int = 1
    settled: bool = True


def _unscaled(weights: np.ndarray, inverse: np.ndarray, s: Scales) -> tuple[np.ndarray, np.ndarray]:
    """Weights and their variances (per unit of residual variance) for the columns as they were before scaling."""
    p = len(s.mean)
    turn = np.zeros((p + 1, p + 1))
    turn[0, 0] = 1.0
    live = s.std > 0
    turn[0, 1:] = np.where(live, -s.mean / np.where(live, s.std, 1.0), 0.0)
    turn[np.arange(1, p + 1), np.arange(1, p + 1)] = np.where(live, 1.0 / np.where(live, s.std, 1.0), 0.0)
    return turn @ weights, np.einsum("ij,jk,ik->i", turn, inverse, turn)


def least_squares(df: DataFrame, target: str, features: Sequence[str]) -> Fit | None:
    """Ordinary least squares from one pass for the scales and one for the products; nothing without spare rows."""
    columns, p = [*features, target], len(features)
    rows = complete_rows(df, columns)
    s = scales(rows, columns)
    dof = s.n - p - 1
    if dof <= 0:
        return None

    def products(block: np.ndarray) -> np.ndarray:
        z = s.scaled(block)
        return (z.T @ z).ravel()

    sums = block_sums(rows, columns, products, (p + 1) ** 2).reshape(p + 1, p + 1)
    inverse = np.zeros((p + 1, p + 1))
    inverse[0, 0], inverse[1:, 1:] = 1.0 / s.n, np.linalg.pinv(sums[:p, :p], hermitian=True)
    slopes = inverse[1:, 1:] @ sums[:p, p]
    residual, whole = max(float(sums[p, p] - slopes @ sums[:p, p]), 0.0), float(sums[p, p])
    weights, variances = _unscaled(np.append(0.0, slopes), inverse, Scales(s.n, s.mean[:p], s.std[:p]))
    weights, spread = weights * s.std[p], s.std[p] ** 2 * residual / dof
    weights[0] += s.mean[p]
    return Fit(weights, np.sqrt(variances * spread), dof, 1.0 - residual / whole if whole > 0 else None)


def logistic(df: DataFrame, target: str, features: Sequence[str], ridge: float = 0.0) -> Fit | None:
    """Logistic regression on a 0/1 target by Newton rounds, each one pass over the rows.

    ``ridge`` penalises half the squared weights of the scaled columns, not the intercept. Classes that the features
    separate have no finite weights: the fit is not ``settled`` and its weights and errors are NaN. Nothing without rows.
    """
    columns, p = [*features, target], len(features)
    rows = complete_rows(df, columns).where(F.col(target).isin(0.0, 1.0))
    s = scales(rows, features)
    if not s.n:
        return None
    weights, penalty, size = np.zeros(p + 1), np.append(0.0, np.full(p, ridge)), p + 1
    settled, rounds = False, 0
    while not settled and rounds < MOST_ROUNDS:
        rounds += 1
        current = weights

        def products(block: np.ndarray, current: np.ndarray = current) -> np.ndarray:
            x = np.column_stack((np.ones(len(block)), s.scaled(block[:, :p])))
            q = 1.0 / (1.0 + np.exp(-(x @ current)))
            miss = block[:, p] - q
            return np.concatenate(((x.T @ (x * (q * (1.0 - q))[:, None])).ravel(), x.T @ miss, [np.abs(miss).sum()]))

        sums = block_sums(rows, columns, products, size * size + size + 1)
        if sums[-1] < 1e-6 * s.n:
            break  # every row is told apart
        hessian = sums[: size * size].reshape(size, size) + np.diag(penalty)
        inverse = np.linalg.pinv(hessian, hermitian=True)
        step = inverse @ (sums[size * size:-1] - penalty * weights)
        weights = weights + step
        settled = bool(np.max(np.abs(step)) <= SETTLED * max(1.0, float(np.max(np.abs(weights)))))
    if not settled:
        return Fit(np.full(size, np.nan), np.full(size, np.nan), s.n - size, rounds=rounds, settled=False)
    plain, variances = _unscaled(weights, inverse, s)
    return Fit(plain, np.sqrt(np.maximum(variances, 0.0)), s.n - size, rounds=rounds, settled=settled)
