"""Lines are hashed a piece at a time: the same bands, in a bounded part of a worker's memory."""

import tracemalloc

import numpy as np

from patronage.llm import line_dedup
from patronage.llm.line_dedup import Fuzzy, line_bands, line_id


def made(bytes_of_lines):
    rng, lines, total = np.random.default_rng(3), {}, 0
    while total < bytes_of_lines:
        line = bytes(rng.integers(97, 123, int(rng.integers(1, 500)), dtype=np.uint8))
        lines[line_id(line)] = line
        total += len(line)
    return lines


def gathered(lines):
    keys, ids = (np.concatenate(c) for c in zip(*line_bands(lines, Fuzzy())))
    return sorted(zip(keys.tolist(), ids.tolist()))


def test_pieces_change_nothing(monkeypatch):
    lines = made(20_000) | {line_id(b"x" * 9_000): b"x" * 9_000}
    whole = gathered(lines)
    monkeypatch.setattr(line_dedup, "PIECE_BYTES", 700)
    assert gathered(lines) == whole and len(whole) == 20 * len(lines)


def test_memory_of_a_batch():
    """A batch of 4 MB took 247 MB when it was hashed in one piece."""
    lines = made(4 << 20)
    tracemalloc.start()
    for _ in line_bands(lines, Fuzzy()):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
