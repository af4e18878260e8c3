"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. In a partition whose largest item has q shingles, each item's sketch is
its q - ceil(t q) + 1 smallest hashes: a document with a share t of the item's shingles has one of them among its own
hashes, whatever its length. Sketch hits are candidates; a candidate's share of the item's shingles is then counted
on the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patronage.llm.linking import bitmap, free_names, in_bitmap, share, text_key
from patronage.llm.textops import PUNCTUATION, as_long, shingles, small_batches, words
from patronage.session import pin

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


@dataclass(frozen=True)
class Containment:
    """A share of at least ``num / den`` of the item's ``size``-word shingles."""

    size: int = 5
    num: int = 80
    den: int = 100

    def minima(self, n: int) -> int:
        """Hashes in the sketch of an item of n shingles, the same for all items of its size partition."""
        largest = (1 << n.bit_length()) - 1
        return largest - -(-self.num * largest // self.den) + 1


def item_sketches(benchmark: DataFrame, rule: Containment) -> DataFrame:
    """(item_id, words, hash): the sketch of each item; ``words`` is its shingle size, less than the rule's for short items."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found, bounds = words(batch.column("text"), PUNCTUATION)
            for i, ident in enumerate(batch.column("item_id").to_pylist()):
                own = found[bounds[i]:bounds[i + 1]]
                if len(own):
                    size = min(rule.size, len(own))
                    hashes = np.unique(shingles(own, np.array([0, len(own)]), size)[0])
                    hashes = hashes[:rule.minima(len(hashes))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ident] * len(hashes), pa.int64()), pa.array([size] * len(hashes), pa.int32()), as_long(hashes)],
                        ["item_id", "words", "hash"],
                    )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(sketch, "item_id long, words int, hash long")


def _hits(docs: DataFrame, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, text_key, hash): all shingles of all documents whose slot the sketches use."""
    shared = share(docs.sparkSession, wanted)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found, bounds = words(batch.column("text"), PUNCTUATION)
            for size in sizes:
                hashes, at = shingles(found, bounds, size, short=False)
                places = np.flatnonzero(in_bitmap(shared.value, hashes.view(np.int64)))
                if len(places):
                    rows = pa.array(np.searchsorted(at, places, side="right") - 1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), as_long(hashes[places])],
                        ["doc_id", "text_key", "hash"],
                    )

    return docs.mapInArrow(probe, "doc_id long, text_key long, hash long")


def _sets(text: str, size: int) -> set[tuple[bytes, ...]]:
    found = _WORD.findall((text or "").encode().lower())
    return {tuple(found[i:i + size]) for i in range(len(found) - size + 1)}


def contained_items(docs: DataFrame, benchmark: DataFrame, rule: Containment = Containment()) -> DataFrame:
    """(doc_id, text_key, item_id, n_shared, n_item, containment): every document and item with the rule's share.

    Words are runs of letters and digits, A-Z lower-cased, so punctuation does not matter. An item with fewer words than a
    shingle is one shingle of all its words; a null item or one without words is found nowhere; a null or short text
    contains what fits in it. Repeated documents or items give one row per distinct (doc_id, text, item_id).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    items = pin(item_sketches(benchmark, rule))
    sizes = sorted(r["words"] for r in items.select("words").distinct().collect())
    wanted = bitmap(items.select("hash"))
    # the bitmap keeps nearly all other shingles from the join; the join is exact
    candidates = pin(
        _hits(rows, wanted, sizes).join(items, "hash").select("doc_id", "text_key", "item_id").distinct()
    )
    near = share(docs.sparkSession, bitmap(candidates.select("text_key")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(near.value, batch.column("text_key").to_numpy())))

    texts = rows.mapInArrow(pick, "doc_id long, text string, text_key long").dropDuplicates(["doc_id", "text_key"])
    same = F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("c.text_key") == F.col("d.text_key"))
    questions = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))
    pairs = (
        candidates.alias("c").join(texts.alias("d"), same).select("c.doc_id", "c.text_key", "c.item_id", "d.text")
        .join(questions, F.col("c.item_id").eqNullSafe(questions["item_id"]))
        .select("doc_id", "text_key", candidates["item_id"], "text", "item_text")
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, item, text, question in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = min(rule.size, len(_WORD.findall((question or "").encode().lower())))
                if not size:
                    continue
                wanted = _sets(question, size)
                n = len(wanted & _sets(text, size))
                if n * rule.den >= rule.num * len(wanted):
                    out.append((doc, key, item, n, len(wanted), n / len(wanted)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(),) * 5 + (pa.float64(),)
            names = ["doc_id", "text_key", "item_id", "n_shared", "n_item", "containment"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    found = pairs.mapInArrow(confirm, "doc_id long, text_key long, item_id long, n_shared long, n_item long, containment double")
    return found.dropDuplicates(["doc_id", "text_key", "item_id"])


def without_items(docs: DataFrame, benchmark: DataFrame, rule: Containment = Containment()) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns."""
    ident, key = free_names(docs, "_id", "_key")
    leaks = pin(contained_items(docs, benchmark, rule).select(F.col("doc_id").alias(ident), F.col("text_key").alias(key)).distinct())
    return docs.join(leaks, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (text_key() == F.col(key)), "left_anti")
