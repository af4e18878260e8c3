"""The eigen solver against numpy's, and whitening against exact arithmetic on small tables."""

import collections
import math
from fractions import Fraction

import numpy as np
import pytest

from patronage.llm.symmetric_eigen import largest_eigenvalues, leading_eigenpairs, sturm_counts, tridiagonal
from patronage.llm.whitening import whiten

RNG = np.random.default_rng(5)


def with_spectrum(values):
    q, _ = np.linalg.qr(RNG.standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


MATRICES = {
    "random": (lambda m: m @ m.T)(RNG.standard_normal((40, 40))),
    "wide range": with_spectrum(10.0 ** -np.arange(0, 30, 1.0)),
    "equal leading": with_spectrum([5.0] * 6 + [2.0] * 6 + list(np.linspace(0, 1, 20))),
    "near leading": with_spectrum([5 + 1e-9 * i for i in range(8)] + [1.0] * 8),
    "negative": with_spectrum(np.linspace(-9, 3, 25)),
    "diagonal": np.diag(np.arange(20.0)),
    "all equal": np.eye(18) * 7,
    "zero": np.zeros((5, 5)),
    "one": np.array([[3.0]]),
    "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    "blocks": np.kron(np.eye(6), np.array([[2.0, 1.0, 0], [1.0, 2.0, 1.0], [0, 1.0, 2.0]])),
    "large": with_spectrum(np.linspace(1e12, 2e12, 30)),
    "tiny": with_spectrum(np.linspace(1e-200, 2e-200, 30)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_leading_eigenpairs(name):
    m = (MATRICES[name] + MATRICES[name].T) / 2
    values, vectors = leading_eigenpairs(m, 16)
    k = min(16, len(m))
    scale = max(np.abs(m).max(), 1e-300)
    assert np.allclose(values / scale, np.linalg.eigvalsh(m)[::-1][:k] / scale, atol=1e-13)
    assert (np.diff(values) <= 1e-13 * scale).all()
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs((m / scale) @ vectors - vectors * (values / scale)).max() < 1e-11


def test_tridiagonal_and_sturm_counts():
    m = MATRICES["random"]
    d, e, q = tridiagonal(m)
    assert np.allclose(q @ (np.diag(d) + np.diag(e, 1) + np.diag(e, -1)) @ q.T, m) and np.allclose(q @ q.T, np.eye(len(m)))
    exact = np.linalg.eigvalsh(m)
    at = np.linspace(exact[0] - 1, exact[-1] + 1, 50)
    assert sturm_counts(d, e, at).tolist() == [(exact < a).sum() for a in at]
    assert np.allclose(largest_eigenvalues(d, e, 40), exact[::-1])


SCHEMA = "vec_id long, embedding array<float>, x string, n int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, "clash") for i, v in rows], SCHEMA).repartition(3)


def sound(rows):
    out = []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]))
    return out


def test_whiten_against_exact_arithmetic(spark):
    rows = [(i, (RNG.standard_normal(24) * np.linspace(1, 30, 24)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [rows[1], rows[1], (None, rows[2][1])]
    rows += [(2000, None), (2001, [1.0] * 23 + [None]), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (2004, []), (2005, [1.0, 2.0])]
    kept = [r for r in sound(rows) if len(r[1]) == 24]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    found = whiten(table(spark, rows)).collect()
    assert len(found) == 16 * len(kept)
    expected = collections.Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept)
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1) == expected
    assert {r["n"] for r in found} == {n}
    covariance = np.array([[float(Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in fit), n**3)) for b in range(24)] for a in range(24)])
    values = np.linalg.eigvalsh(covariance)[::-1][:16]
    explained = {r["component"]: r["explained"] for r in found}
    assert np.allclose([explained[k + 1] for k in range(16)], values / np.trace(covariance), rtol=1e-10)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    # the whitened distinct vectors have unit covariance, and each component follows its eigenvector
    x_of = {i: x for i, x in kept}
    white = collections.defaultdict(dict)
    for r in found:
        white[r["vec_id"]][r["component"]] = r["whitened"]
    ids = list({tuple(x): i for i, x in x_of.items() if i is not None}.values())
    w = np.array([[white[i][k + 1] for k in range(16)] for i in ids])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(16)).max() < 1e-9
    centred = np.array([x_of[i] for i in ids]) - np.array(sums) / n
    back = np.linalg.lstsq(centred, w, rcond=None)[0] * np.sqrt(values)
    assert np.abs(covariance @ back - back * values).max() < 1e-6 * values[0]


def test_whiten_narrow_constant_and_empty(spark):
    narrow = whiten(table(spark, [(1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [4.0, 5.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in narrow) == [(i, k) for i in (1, 2, 3) for k in (1, 2)]
    line = {(r["vec_id"], r["component"]): r for r in whiten(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])).collect()}
    assert abs(abs(line[1, 1]["whitened"]) - 1) < 1e-12 and line[1, 2]["whitened"] is None and line[1, 1]["explained"] == pytest.approx(1)
    same = whiten(table(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0]), (None, [0.5, 2.0])])).collect()
    assert len(same) == 6 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in same)
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, None), (2, [])])).count() == 0


def test_whiten_very_large_numbers(spark):
    rows = [(i, [float(2.0 ** (40 + i % 3)), float(-(2.0**50)) * (i % 2), 1.0 * i]) for i in range(12)]
    kept = sound(rows)
    n, sums = len({tuple(x) for _, x in kept}), [sum(c) for c in zip(*{tuple(x) for _, x in kept}, strict=True)]
    found = {r["vec_id"]: r["deviation"] for r in whiten(table(spark, rows + [(99, [3e38, 0.0, 0.0])])).collect()}
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    assert found == {i: d if d < 1 << 63 else None for i, d in exact.items()}
