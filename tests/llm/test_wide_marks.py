"""Wide parity marks: they rule out pairs of large sets and never a link, and the join they serve stays exact."""

import numpy as np
import pytest

from patronage.llm.linking import MARK_BITS, odd_bits, wide_marks
from patronage.llm.ngram_join import Similarity, _alike, ngram_components


def values(rng, n):
    return rng.integers(0, 1 << 63, n).astype(np.uint64)


@pytest.mark.parametrize("n, changed", [(1100, 0), (2040, 30), (2048, 100), (6000, 250), (6000, 3000)])
def test_wide_marks_differ_in_no_more_bits_than_sets_in_elements(n, changed):
    rng = np.random.default_rng(n + changed)
    a = values(rng, n)
    b = np.concatenate([a[changed:], values(rng, changed + 20)])
    odd = odd_bits(wide_marks(a), wide_marks(b))
    assert odd == odd_bits(wide_marks(b), wide_marks(a)) <= 2 * changed + 20
    assert odd > (2 * changed + 20) * (0.3 if changed * 2 > n * 0.5 else 0.6)
    assert wide_marks(a[:MARK_BITS]) is None


def test_large_sets_that_share_little_are_ruled_out(spark):
    rng = np.random.default_rng(5)
    a = values(rng, 6000)
    sets = {1: a, 2: np.concatenate([a[100:], values(rng, 100)]), 3: np.concatenate([a[:600], values(rng, 5400)]), 4: a[:1000]}
    wide = spark.createDataFrame([(i, bytearray(m)) for i, s in sets.items() if (m := wide_marks(s))], "id long, wide binary")
    pairs = spark.createDataFrame([(x, y, len(sets[x]), len(sets[y])) for x in sets for y in sets if x > y], "a long, b long, n_a long, n_b long")
    kept = {(r["a"], r["b"]) for r in _alike(pairs, wide, Similarity(3, 90, 100)).collect()}
    assert kept == {(2, 1), (4, 1), (4, 2), (4, 3)}


def test_long_documents_join_exactly(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 3000, 2600)]
    texts = [base]
    for changes in (10, 40, 43, 44, 45, 48, 60, 400):
        copy = list(base)
        for i in rng.choice(2600, changes, replace=False):
            copy[i] = f"new{changes}x{i}"
        texts.append(copy)
    texts += [base[:1300] + texts[-1][1300:], base[:2400], [f"w{i}" for i in rng.integers(0, 3000, 2600)]]
    sets = [{tuple(t[i:i + 3]) for i in range(len(t) - 2)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for x, s in enumerate(sets):
            for y, t in enumerate(sets):
                if 100 * len(s & t) >= 90 * len(s | t):
                    root[x] = root[y] = min(root[x], root[y])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(docs, Similarity(3, 90, 100)).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
