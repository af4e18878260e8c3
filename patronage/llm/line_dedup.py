"""Fuzzy deduplication of lines by MinHash over character shingles.

Every distinct line gets a signature of one smallest hash per bin, bands of the signature become bucket keys, lines of a
key are compared exactly, and one line of each connected component stays in the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from patronage.llm.linking import bitmap, free_shuffles, in_bitmap, linked_components, parity_marks, share, text_key
from patronage.llm.textops import U, as_long, mix, mix_one, small_batches
from patronage.session import pin

_EMPTY = np.iinfo(np.uint64).max
#: Bytes of lines that are hashed at once; their shingles and signatures take some sixty times as much memory.
PIECE_BYTES = 1 << 18
#: Buckets in which lines of a key meet; a bucket of 30 GB of documents takes some 10 MB.
BUCKET_BITS = 12
#: Bits of a line's id that go to the buckets. Lines whose ids share them are told apart when pairs are made.
NAME_BITS = 40
NAME_MASK = (1 << NAME_BITS) - 1
#: Band keys that a task holds before it sends them.
SENT_KEYS = 1 << 19
#: A band key without its bucket, and the line's name.
ENTRY = np.dtype([("key", "<u4"), ("low", "<u4"), ("high", "u1")])


@dataclass(frozen=True)
class Fuzzy:
    """Jaccard similarity ``num / den`` of ``size``-character shingles; ``bands`` of ``rows`` bins each.

    Lines share a band at similarity 0.8 with probability 1 - (1 - 0.8 ** 4) ** 20 = 0.99997, at 0.85 with 0.9999996.
    """

    size: int = 5
    num: int = 80
    den: int = 100
    bands: int = 20
    rows: int = 4

    def narrowed(self, rows: int = 6) -> Fuzzy:
        """Bands of more rows, and so many of them that linked lines share one at least as surely as they do under this rule.

        Lines far below the similarity, of which there are the more the larger the corpus is, share far fewer of them.
        """
        if self.rows >= rows or self.num == self.den:
            return self
        missed, missed_now = (math.log1p(-((self.num / self.den) ** r)) for r in (self.rows, rows))
        return replace(self, bands=math.ceil(self.bands * missed / missed_now), rows=rows)


def lines_of(text) -> list[bytes]:
    """The lines of a text, A-Z lower-cased, without outer blanks."""
    return [line.strip() for line in text.as_py().encode().lower().split(b"\n")]


def line_id(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def _distinct(batch: pa.RecordBatch) -> dict[int, bytes]:
    """The distinct lines of a batch that are not blank, by id."""
    return {line_id(line): line for text in batch.column("text") for line in set(lines_of(text)) if line}


def _pieces(lines: list[bytes]) -> Iterator[slice]:
    """Slices of about ``PIECE_BYTES`` bytes of lines, or of one line if it is longer."""
    ends, start = np.cumsum([len(line) for line in lines], dtype=np.int64), 0
    while start < len(lines):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
        yield slice(start, stop)
        start = stop


def shingle_hashes(lines: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of all lines, one after the other, and the line of each."""
    decoded = [line.decode(errors="replace") for line in lines]
    chars = np.frombuffer("".join(decoded).encode("utf-32-le"), dtype=np.uint32)
    n = np.array([len(d) for d in decoded])
    codes, ends = mix(chars.astype(U) + U(31)), np.cumsum(n)
    left = np.repeat(ends, n) - np.arange(len(chars))
    sums = np.zeros(len(chars), dtype=U)
    for j in range(size):
        part = codes[j:] * U(mix_one(50 + j) | 1)
        short = left[: len(chars) - j] <= j  # a line shorter than a shingle is one shingle
        part[short] = 0
        sums[: len(chars) - j] += part
    valid = left >= size
    valid[ends - n] = True
    return mix(sums[valid]), np.repeat(np.arange(len(lines)), n)[valid]


def signatures(hashes: np.ndarray, line: np.ndarray, lines: int, bins: int) -> np.ndarray:
    """One-permutation MinHash: the smallest hash in each bin; an empty bin tries the others in an order of its own.

    Bins of a band so come from different ones in short lines too, where neighbours would all take the same.
    """
    packed = ((line * bins).astype(U) + (hashes >> U(40)) % U(bins) << U(36)) | hashes & U((1 << 36) - 1)
    packed.sort()
    place = (packed >> U(36)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    first = np.full(lines * bins, _EMPTY, dtype=U)
    first[place[starts]] = packed[starts] & U((1 << 36) - 1)
    first = first.reshape(lines, bins)
    order = np.argsort(mix(np.arange(bins * bins, dtype=U) + U(7)).reshape(bins, bins), axis=1)
    table, (row, column) = first.copy(), np.nonzero(first == _EMPTY)
    for step in range(bins):
        if not len(row):
            break
        found = first[row, order[column, step]]
        table[row, column] = found
        still = found == _EMPTY
        row, column = row[still], column[still]
    return table


def line_bands(found: dict[int, bytes], rule: Fuzzy) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket keys of the bands of the lines, and the line's id of each; a piece of the lines at a time."""
    factors = np.array([mix_one(70 + r) | 1 for r in range(rule.rows)], dtype=U)
    names, lines = np.fromiter(found, dtype=U, count=len(found)), list(found.values())
    for piece in _pieces(lines):
        own = lines[piece]
        table = signatures(*shingle_hashes(own, rule.size), len(own), rule.bands * rule.rows)
        grouped = table.reshape(len(own), rule.bands, rule.rows)
        keys = mix(mix((grouped * factors).sum(axis=2, dtype=U)) + np.arange(rule.bands, dtype=U))
        yield keys.ravel(), np.repeat(names[piece], rule.bands)


def band_members(texts: DataFrame, rule: Fuzzy) -> DataFrame:
    """(key, id, centre): by band, the names of all lines that share it but the smallest, the centre.

    A task sends the keys of its lines as one row for each bucket, 9 bytes for each key.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            entries = np.empty(len(keys), dtype=ENTRY)
            entries["key"], entries["low"], entries["high"] = keys & U(0xFFFFFFFF), ids & U(0xFFFFFFFF), (ids >> U(32)) & U(0xFF)
            bucket = (keys >> U(64 - BUCKET_BITS)).astype(np.int32)
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = pa.array(np.append(begin, len(keys)) * ENTRY.itemsize, pa.int32())
            blobs = pa.Array.from_buffers(pa.binary(), len(begin), [None, ends.buffers()[1], pa.py_buffer(entries.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), blobs], ["bucket", "entries"])

        held, n = [], 0
        for batch in small_batches(batches):
            for keys, ids in line_bands(_distinct(batch), rule):
                held.append((keys, ids))
                n += len(keys)
                if n >= SENT_KEYS:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    def meet(part: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(part.column("entries").to_pylist()), dtype=ENTRY)
        names, bucket = entries["low"].astype(np.int64) | entries["high"].astype(np.int64) << 32, part.column("bucket")[0].as_py()
        order = np.lexsort((names, entries["key"]))
        key, names = entries["key"][order], names[order]
        first = np.append(True, key[1:] != key[:-1])
        centre = names[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        keep = (names != centre) & np.append(True, first[1:] | (names[1:] != names[:-1]))
        columns = [key[keep].astype(np.int64) | np.int64(bucket) << 32, names[keep], centre[keep]]
        return pa.table([pa.array(c) for c in columns], ["key", "id", "centre"])

    return texts.mapInArrow(bands, "bucket int, entries binary").groupBy("bucket").applyInArrow(meet, "key long, id long, centre long")


def _occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, id): every line that is not blank."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [
                (i, number, line_id(line)) for i, text in enumerate(batch.column("text")) for number, line in enumerate(lines_of(text)) if line
            ]
            row, number, ids = (np.array(c, dtype=U) for c in zip(*found, strict=True)) if found else [np.zeros(0, U)] * 3
            row = pa.array(row.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("text_key").take(row), pa.array(number.astype(np.int32)), as_long(ids)],
                ["doc_id", "text_key", "line", "id"],
            )

    return rows.mapInArrow(name, "doc_id long, text_key long, line int, id long")


def _chosen(batch: pa.RecordBatch, wanted: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Ids and bytes of the distinct lines of a batch that are in the bitmap."""
    found = _distinct(batch)
    ids = np.fromiter(found, dtype=U, count=len(found))
    ids = ids[in_bitmap(wanted, ids.view(np.int64))]
    return ids, [found[i] for i in ids.tolist()]


def _line_marks(rows: DataFrame, wanted: np.ndarray, rule: Fuzzy) -> DataFrame:
    """(id, name, n, marks) of the lines in the bitmap: number and parity marks of the line's shingles."""
    shared = share(rows.sparkSession, wanted)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            names, lines = _chosen(batch, shared.value)
            for piece in _pieces(lines):
                own = lines[piece]
                hashes, line = shingle_hashes(own, rule.size)
                sets = [np.unique(part) for part in np.split(hashes, np.searchsorted(line, np.arange(1, len(own))))]
                yield pa.RecordBatch.from_arrays(
                    [
                        as_long(names[piece]), as_long(names[piece] & U(NAME_MASK)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([parity_marks(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "name", "n", "marks"],
                )

    return rows.select("text").mapInArrow(pick, "id long, name long, n long, marks array<long>").dropDuplicates(["id"])


def _line_texts(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(id, text) of the lines in the bitmap."""
    shared = share(rows.sparkSession, wanted)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            names, lines = _chosen(batch, shared.value)
            yield pa.RecordBatch.from_arrays([as_long(names), pa.array([x.decode(errors="replace") for x in lines], pa.string())], ["id", "text"])

    return rows.select("text").mapInArrow(pick, "id long, text string").dropDuplicates(["id"])


def _shingle_set(line: str, size: int) -> set[str]:
    return {line[i:i + size] for i in range(max(1, len(line) - size + 1))}


def line_components(rows: DataFrame, rule: Fuzzy) -> DataFrame:
    """(id, root) of the lines that are linked to another one."""
    members = pin(band_members(rows.select("text"), rule.narrowed()))
    free_shuffles(rows.sparkSession)
    near = pin(members.select(F.explode(F.array("id", "centre")).alias("name")).distinct())
    lines = pin(_line_marks(rows, bitmap(near), rule).join(near, "name", "left_semi"))
    free_shuffles(rows.sparkSession)

    def verify(pairs: DataFrame) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                    own, other = _shingle_set(a, rule.size), _shingle_set(b, rule.size)
                    n = len(own & other)
                    keep.append(n * rule.den >= rule.num * (len(own) + len(other) - n))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        # only texts of lines in a pair are shuffled
        pairs = pin(pairs)
        texts = _line_texts(rows, bitmap(pairs.select(F.explode(F.array("a", "b")))))
        a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        free_shuffles(rows.sparkSession)
        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")

    return linked_components(members, lines, verify, rule.num, rule.den)


def _in(rows: DataFrame, column: str, wanted: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose hash in ``column`` is in the bitmap, or those whose hash is not."""
    shared = share(rows.sparkSession, wanted)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shared.value, batch.column(column).to_numpy()) == inside))

    return rows.mapInArrow(pick, rows.schema)


def dedup_lines(docs: DataFrame, rule: Fuzzy = Fuzzy()) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for every row of (doc_id, text, ...): the text without its removed lines.

    Lines are cut at line feeds, compared without outer blanks and with A-Z lower-cased. Lines link when their sets of
    character shingles have at least the given similarity; a line shorter than a shingle is one. Of all lines of a
    component the first stays, by doc_id (null last), text and place; blank lines stay. Rows equal in id and text are
    treated alike. A null text has no lines and stays null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    roots = pin(line_components(rows, rule))
    free_shuffles(rows.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "text_key", "line")
    found = pin(_occurrences(rows))
    per_line = found.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    linked = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    # a line that occurs once and is linked to no other one stays
    named = per_line.join(linked, "id", "left").where("n > 1 OR root IS NOT NULL").select("id", F.coalesce("root", "id").alias("root"), "first")
    named = pin(named)
    groups = named.groupBy("root").agg(F.min("first").alias("first"))
    several = pin(named.select("id", "root").join(groups, "root").select("id", "first"))
    lost = pin(
        _in(found, "id", bitmap(several.select("id"))).join(several, "id").where(place != F.col("first"))
        .groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lost"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "lost")
    )
    free_shuffles(rows.sparkSession)
    losing = bitmap(lost.select("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, lost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = [] if text is None else text.split("\n")
                gone = set(lost or ())
                kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
                out.append((doc, len(lines), len(gone), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_lines", "n_removed", "text"])

    # only texts that may lose a line are shuffled
    joined = _in(rows, "text_key", losing).join(lost, same, "left").select("doc_id", "text", "lost")
    whole = _in(rows, "text_key", losing, False).select("doc_id", "text", F.lit(None).cast("array<int>").alias("lost"))
    return joined.unionByName(whole).mapInArrow(cut, "doc_id long, n_lines long, n_removed long, text string")
