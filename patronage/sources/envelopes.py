"""Large search replies read by several tasks: ``{"hits": [record, ...], ...}`` cut at record borders.

A byte range of a JSON text cannot tell by itself whether it begins inside a string, or how deep. So every range first
reports how many quotes it holds and how its depth would change in either case; put together in order, these few numbers
tell each range where it begins. Ranges then find the array of hits, and the records that begin in them, which each task
reads to their end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.sources.readers import HIT_FIELDS, parse_hits

#: Bytes of a range, and by which a task reads on to finish its last record.
RANGE_BYTES, MORE_BYTES = 32 << 20, 1 << 16
_QUOTE, _BACKSLASH = 34, 92
_DEPTH = np.zeros(256, dtype=np.int64)
_DEPTH[[123, 91]], _DEPTH[[125, 93]] = 1, -1
_KEY = re.compile(rb'"hits"\s*:\s*\Z')


@dataclass(frozen=True)
class Place:
    """Where a range begins: inside a string or not, and how many brackets are open."""

    inside: bool
    depth: int


def _opened(path: str) -> pa.NativeFile:
    """A file of the local file system or of any that pyarrow can reach by its address."""
    system, local = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(local)


def _bytes(file: pa.NativeFile, start: int, stop: int) -> bytes:
    file.seek(start)
    return file.read(stop - start)


def _aligned(file: pa.NativeFile, start: int, stop: int, size: int) -> tuple[int, int]:
    """The range without a border behind a backslash, which would tell an escape from what it escapes."""

    def border(at: int) -> int:
        while 0 < at < size and _bytes(file, at - 1, at) == b"\\":
            at += 1
        return at

    return border(start), border(min(stop, size))


def _outside(data: bytes, inside: bool) -> tuple[np.ndarray, int]:
    """Which bytes stand outside strings (quotes do not), and the number of quotes that open or close one."""
    raw = np.frombuffer(data, dtype=np.uint8)
    quote = raw == _QUOTE
    slashes = np.flatnonzero(raw == _BACKSLASH)
    if len(slashes):
        # a quote is text if an odd run of backslashes ends before it
        runs = np.split(slashes, np.flatnonzero(np.diff(slashes) > 1) + 1)
        ends = np.array([r[-1] + 1 for r in runs if len(r) % 2 and r[-1] + 1 < len(raw)], dtype=np.int64)
        quote[ends] = False
    parity = (np.cumsum(quote) + inside) & 1
    return (parity == 0) & ~quote, int(quote.sum())


def summary(data: bytes) -> tuple[int, int, int]:
    """Quotes of a range, and how the depth changes in it if it begins outside or inside a string."""
    raw = np.frombuffer(data, dtype=np.uint8)
    found = [_outside(data, inside) for inside in (False, True)]
    return found[0][1], *(int(_DEPTH[raw[free]].sum()) for free, _ in found)


def _depths(data: bytes, place: Place) -> tuple[np.ndarray, np.ndarray]:
    """Brackets outside strings: their positions, and the depth before each."""
    raw = np.frombuffer(data, dtype=np.uint8)
    free, _ = _outside(data, place.inside)
    at = np.flatnonzero(free & (_DEPTH[raw] != 0))
    change = _DEPTH[raw[at]]
    return at, place.depth + np.cumsum(change) - change


def arrays(data: bytes, before: bytes, place: Place) -> tuple[list[int], list[int]]:
    """Positions behind the openings of arrays named hits at the first level, and of the ends of arrays there."""
    at, depth = _depths(data, place)
    opened = [int(i) + 1 for i in at[depth == 1] if data[i] == 91 and _KEY.search(before + data[:i] if i < 64 else data[max(0, i - 256):i])]
    return opened, [int(i) for i in at[depth == 2] if data[i] == 93]


def records(file: pa.NativeFile, start: int, stop: int, size: int, place: Place, first: int, last: int) -> Iterator[bytes]:
    """The records that begin in a range and lie in the array from ``first`` to ``last``."""
    data, end = _bytes(file, start, stop), stop
    at, depth = _depths(data, place)
    begins = [int(i) for i in at[depth == 2] if data[i] == 123 and first <= start + i < last]

    def closings() -> np.ndarray:
        return at[(depth == 3) & (np.frombuffer(data, dtype=np.uint8)[at] == 125)]

    ends = closings()
    for begin in begins:
        while (found := int(np.searchsorted(ends, begin))) == len(ends):
            if end >= size:
                raise ValueError(f"a record at byte {start + begin} has no end")
            # the last record goes on in the next range
            end = _aligned(file, 0, end + max(MORE_BYTES, end - start), size)[1]
            data = _bytes(file, start, end)
            at, depth = _depths(data, place)
            ends = closings()
        yield data[begin:int(ends[found]) + 1]


def read_large_hits(spark: SparkSession, paths: str | Sequence[str], fields: str = HIT_FIELDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of large envelope files, each read by as many tasks as it has ranges of ``range_bytes``.

    Records are objects in the array ``hits`` at the first level; other keys may stand before and after it. A path is local
    to all executors, or an address that pyarrow can open.
    """
    sizes = {}
    for path in [paths] if isinstance(paths, str) else paths:
        with _opened(path) as file:
            sizes[path] = file.size()
    borders = [(p, i * range_bytes, min((i + 1) * range_bytes, size), size) for p, size in sizes.items() for i in range(-(-size // range_bytes))]
    if not borders:
        return parse_hits(spark.createDataFrame([], "value string"), "value", fields)

    def each(make, schema: str, extra: dict[tuple[str, int], tuple] | None = None, more: str = ""):
        """Runs ``make(file, start, stop, size, *extra of the range)`` over all ranges, one task each, for rows of ``schema``."""
        names = ["path", "start", *[c.split()[0] for c in schema.split(", ")]]
        kinds = {"long": pa.int64(), "string": pa.string()}
        types = [pa.string(), pa.int64(), *[kinds[c.split()[1]] for c in schema.split(", ")]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, path, start, stop, size, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with _opened(path) as file:
                        begin, end = _aligned(file, start, stop, size)
                        rows = list(make(file, begin, end, size, *own))
                    columns = [[path] * len(rows), [start] * len(rows), *([r[i] for r in rows] for i in range(len(names) - 2))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        given = [(n, *b, *(extra[b[:2]] if extra else ())) for n, b in enumerate(borders)]
        ranges = spark.createDataFrame(given, f"number long, path string, start long, stop long, size long{more}")
        return ranges.repartitionByRange(len(given), "number").mapInArrow(run, f"path string, start long, {schema}")

    counted = each(lambda file, a, b, _: [summary(_bytes(file, a, b))], "quotes long, outside long, inside long")
    places, last_path, inside, depth = {}, None, False, 0
    for path, start, quotes, change, change_inside in sorted(tuple(r) for r in counted.collect()):  # a few numbers a range
        if path != last_path:
            last_path, inside, depth = path, False, 0
        places[path, start] = (inside, depth)
        depth += change_inside if inside else change
        inside ^= bool(quotes % 2)

    def edges(file, start, stop, _, inside_, depth_):
        opened, closed = arrays(_bytes(file, start, stop), _bytes(file, max(0, start - 256), start), Place(inside_, depth_))
        return [(start + i, 1) for i in opened] + [(start + i, 0) for i in closed]

    keys: dict[str, list[tuple[int, int]]] = {}
    for r in each(edges, "at long, opens long", places, ", inside boolean, depth long").collect():  # arrays at the first level
        keys.setdefault(r["path"], []).append((r["at"], r["opens"]))
    hits = {}
    for path, found in keys.items():
        first = next((at for at, opens in sorted(found) if opens), None)
        if first is not None:
            hits[path] = (first, next((at for at, opens in sorted(found) if not opens and at >= first), sizes[path]))

    def cut(file, start, stop, size, inside_, depth_, first, last):
        return [(r.decode(),) for r in records(file, start, stop, size, Place(inside_, depth_), first, last)]

    known = {k: (*place, *hits.get(k[0], (0, 0))) for k, place in places.items()}
    texts = each(cut, "record string", known, ", inside boolean, depth long, first long, last long")
    return parse_hits(texts.select(F.concat(F.lit('{"hits":['), "record", F.lit("]}")).alias("value")), "value", fields)
