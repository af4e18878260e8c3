"""Bands of more rows: no link less sure, far fewer unrelated lines that meet; short lines do not meet by their empty bins."""

import numpy as np

from patronage.llm.line_dedup import Fuzzy, band_members, line_bands, line_id, shingle_hashes
from patronage.llm.linking import MARK_BITS, half_marks, parity_marks


def test_narrowed_bands_are_as_sure():
    rule = Fuzzy()
    now = rule.narrowed()
    assert (now.bands, now.rows, rule.bands, rule.rows) == (35, 6, 20, 4)
    for s in np.arange(0.8, 1, 0.01):
        assert (1 - s**now.rows) ** now.bands <= (1 - s**rule.rows) ** rule.bands
    assert Fuzzy(rows=6).narrowed() == Fuzzy(rows=6) and Fuzzy(num=1, den=1).narrowed() == Fuzzy(num=1, den=1)


def prose(rng, n):
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(150)]
    return [" ".join(rng.choice(words, 9)).encode() for _ in range(n)]


def test_unrelated_short_lines_do_not_meet():
    """Neighbouring empty bins took one value all, so that a band of six came from one bin: each of these lines met another."""
    lines = {line_id(x): x for x in prose(np.random.default_rng(5), 3000)}
    keys, ids = (np.concatenate(c) for c in zip(*line_bands(lines, Fuzzy().narrowed())))
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    assert len(np.unique(ids[count[place] > 1])) < 0.04 * len(lines)


def test_members_meet_as_their_keys_do(spark):
    lines = prose(np.random.default_rng(6), 60)
    texts = [b"\n".join([x, x[:-1] + b"z"]).decode() for x in lines] + [lines[0].decode(), None, ""]
    found = {line_id(x): x for t in texts if t for x in t.encode().split(b"\n")}
    keys, ids = (np.concatenate(c).tolist() for c in zip(*line_bands(found, Fuzzy())))
    by_key = {}
    for k, i in zip(keys, ids):
        by_key.setdefault(k >> 52 << 32 | k & 0xFFFFFFFF, set()).add(i & ((1 << 40) - 1))
    expected = {(k, i, min(own)) for k, own in by_key.items() for i in own if i != min(own)}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = [tuple(r) for r in band_members(df, Fuzzy()).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 300


def test_half_marks_are_the_parity_of_half_the_bits(spark):
    hashes, _ = shingle_hashes(prose(np.random.default_rng(7), 1), 5)
    df = spark.createDataFrame([(parity_marks(np.unique(hashes)).tolist(),)], "marks array<long>")
    assert df.select(half_marks("marks")).first()[0] == parity_marks(np.unique(hashes), MARK_BITS // 2).tolist()
