"""Words, shingles and 64-bit hashes of whole texts, in numpy over the bytes of an Arrow batch.

Texts are folded by lower-casing A-Z only; blanks are the space and the bytes 9 to 13. Hashes are sums of
mixed (byte, place) pairs, mixed again, so they do not depend on batches, tasks or machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PIECE = 1 << 18
BATCH_BYTES = 4 << 20

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Blanks and all other ASCII characters but letters and digits.
PUNCTUATION = BLANK.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit moves about half of the output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_one(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=U))[0])


def as_long(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(x.view(np.int64))


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, or one row if it is longer; null texts become empty.

    A batch is cut before its texts are touched, so only one small part at a time has a second copy.
    """
    for batch in batches:
        place = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part.set_column(place, column, pc.fill_null(part.column(place), "").cast(pa.large_string()))
            start = stop


def folded_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with A-Z lower-cased, and where each text begins (one more entry than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset:]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return _FOLD[raw], offsets - offsets[0]


def words(texts: pa.Array, separators: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where the words of each text begin (one more entry than texts)."""
    data, bounds = folded_bytes(texts)
    blank = separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    cuts = np.flatnonzero(blank | edge[:-1])
    hashes, starts, start = [], [], 0
    while start < len(data):
        later = np.searchsorted(cuts, start + PIECE)
        stop = int(cuts[later]) if later < len(cuts) else len(data)
        gap = blank[start:stop]
        begin = ~gap
        begin[1:] &= gap[:-1] | edge[start + 1:stop]
        solid = ~gap
        chars = data[start:stop][solid].astype(U)
        at = np.flatnonzero(begin[solid])
        if len(at):
            sizes = np.diff(np.append(at, len(chars)))
            place = np.arange(len(chars)) - np.repeat(at, sizes)
            sums = np.add.reduceat(mix(chars + (place.astype(U) << U(8)) + U(0x9E3779B97F4A7C15)), at)
            hashes.append(mix(sums + sizes.astype(U)))
            starts.append(np.flatnonzero(begin) + start)
        start = stop
    if not hashes:
        return np.zeros(0, dtype=U), np.zeros(len(bounds), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingles(word_hashes: np.ndarray, bounds: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text, and where those of each text begin.

    With ``short``, a text of fewer words has its whole sequence as one shingle; without, it has none.
    """
    lengths = np.diff(bounds)
    total = len(word_hashes)
    if not total:
        return np.zeros(0, dtype=U), np.zeros(len(bounds), dtype=np.int64)
    factors = [U(mix_one(j + 1) | 1) for j in range(size)]
    sums = np.zeros(total, dtype=U)
    for j, factor in enumerate(factors):
        sums[: total - j] += word_hashes[j:] * factor
    values = mix(sums + U(size))
    left = np.repeat(bounds[1:], lengths) - np.arange(total)
    valid = left >= size
    if short:
        for n in range(1, size):
            at = bounds[:-1][lengths == n]
            values[at] = mix(sum(word_hashes[at + j] * factors[j] for j in range(n)) + U(n))
            valid[at] = True
    counted = np.concatenate(([0], np.cumsum(valid)))
    return values[valid], counted[bounds]


def per_text(values: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct values of each text."""
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(values[start:stop])
