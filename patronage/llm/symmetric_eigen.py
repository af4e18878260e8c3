"""Leading eigenpairs of a symmetric matrix: tridiagonal form by reflections, bisection by Sturm counts, inverse iteration.

The matrix is as wide as the vectors, not as long as the table, so the driver solves it.
"""

from __future__ import annotations

import numpy as np

#: Eigenvalues nearer than this part of the norm are a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
ITERATIONS = 6


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q tridiagonal q^T the matrix: one reflection clears each column below its neighbour."""
    a, n = np.array(matrix, dtype=np.float64), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1:, k]
        # only a column with something to clear needs a reflection
        if not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        v /= np.linalg.norm(v)
        a[k + 1:, :] -= 2.0 * np.outer(v, v @ a[k + 1:, :])
        a[:, k + 1:] -= 2.0 * np.outer(a[:, k + 1:] @ v, v)
        q[:, k + 1:] -= 2.0 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each place: the negative pivots of its shifted factors."""
    tiny = np.finfo(np.float64).tiny
    floor = max(np.finfo(np.float64).eps * np.max(np.abs(off), initial=0.0) ** 2, tiny)
    count, pivot = np.zeros(len(at), dtype=np.int64), np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < floor, -floor, pivot)
        count += pivot < 0
    return count


def largest_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its bracket cannot be halved."""
    n = len(diagonal)
    radius = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    low = np.full(k, np.min(diagonal - radius))
    high = np.full(k, np.max(diagonal + radius))
    pad = np.finfo(np.float64).eps * n * max(abs(low[0]), abs(high[0]), np.finfo(np.float64).tiny)
    low, high = low - pad, high + pad
    wanted = n - 1 - np.arange(k)  # so many eigenvalues are smaller
    while True:
        middle = 0.5 * (low + high)
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = sturm_counts(diagonal, off, middle) <= wanted
        low, high = np.where(open_ & above, middle, low), np.where(open_ & ~above, middle, high)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """Solves (tridiagonal - shift) x = b by elimination with row exchanges; pivots below ``floor`` are raised to it."""
    n = len(diagonal)
    d, up, up2, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        below, right, far = off[i], d[i + 1], up[i + 1]
        if abs(below) > abs(d[i]):
            # the next row has the larger pivot
            factor = d[i] / below
            d[i], d[i + 1] = below, up[i] - factor * right
            up[i], up[i + 1], up2[i] = right, -factor * far, far
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            pivot = d[i] if abs(d[i]) > floor else floor
            factor = below / pivot
            d[i], d[i + 1] = pivot, right - factor * up[i]
            x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        rest = x[i]
        if i + 1 < n:
            rest -= up[i] * x[i + 1]
        if i + 2 < n:
            rest -= up2[i] * x[i + 2]
        x[i] = rest / (d[i] if abs(d[i]) > floor else floor)
    return x


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as columns; ``k`` is cut to the width.

    Vectors of a cluster are made orthogonal after every step of the inverse iteration, so equal eigenvalues
    have an orthonormal basis, too.
    """
    n = len(matrix)
    k = min(k, n)
    # entries of at most one, so that no square of a small one vanishes
    scale = float(np.max(np.abs(matrix), initial=0.0)) or 1.0
    diagonal, off, q = tridiagonal(np.asarray(matrix) / scale)
    values = largest_eigenvalues(diagonal, off, k)
    norm = float(np.max(np.abs(diagonal)) + 2 * np.max(np.abs(off), initial=0.0)) or 1.0
    floor, random = np.finfo(np.float64).eps * norm, np.random.default_rng(11)
    vectors, begin, shift = np.zeros((n, k)), 0, 0.0
    for j in range(k):
        # vectors of one cluster come from shifts that differ a little
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            begin = j
        shift = values[j] if j == begin else min(values[j], shift - 4 * floor)
        x = random.standard_normal(n)
        for _ in range(ITERATIONS):
            x = _solve(diagonal, off, shift, x, floor)
            x /= np.max(np.abs(x))
            for _ in range(2):
                x -= vectors[:, begin:j] @ (vectors[:, begin:j].T @ x)
            x /= np.linalg.norm(x)
        vectors[:, j] = x
    return values * scale, q @ vectors
