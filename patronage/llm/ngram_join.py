"""N-gram Jaccard self-join of documents by vertical partitioning.

N-grams have one global order: rough frequency first (from a table of counters of fixed size over all documents), then their
64-bit hashes. Two linked sets share an n-gram within the first (1 - t) of either set, so the fronts of all sets, joined
n-gram by n-gram, leave the pairs that can be links. The order of hashes is cut into fragments; the overlaps of a
candidate pair are counted fragment by fragment and summed.

Any function of the n-gram is a valid order, so rough counters cost candidates at most, never a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patronage.llm.linking import Fronts, bitmap, free_names, free_shuffles, front_components, in_bitmap, odd_bits, parity_marks, share, text_key, wide_marks
from patronage.llm.textops import U, as_long, mix, mix_one, per_text, shingles, small_batches, words
from patronage.session import pin

#: Fragments in which the overlap of a pair is counted: a row holds about so many parts less of a document's n-grams.
COUNT_FRAGMENTS = 4
#: Counters of n-grams by the first bits of their hash, whatever the input; they travel in parts.
COUNTER_BITS, COUNTER_PARTS = 18, 8
LOW_56 = U((1 << 56) - 1)


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``num / den`` on sets of ``size``-word shingles."""

    size: int = 5
    num: int = 80
    den: int = 100


def _set_key(grams: np.ndarray) -> int:
    return mix_one(int(np.add.reduce(mix(grams ^ U(0xA5A5A5A5A5A5A5A5)))) + mix_one(len(grams)))


def _signed(value: int) -> int:
    return np.array(value, dtype=U).view(np.int64).item()


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in small_batches(batches):
        yield batch, list(per_text(*shingles(*words(batch.column("text")), size)))


SETS = "doc_id long, text_key long, n_shingles long, set_key long, marks array<long>, wide binary"


def document_sets(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, marks, wide) for every row; equal sets have equal keys, an empty set has none."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, similarity.size):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_signed(_set_key(s)) if len(s) else None for s in sets], pa.int64()),
                    pa.array([parity_marks(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([wide_marks(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "set_key", "marks", "wide"],
            )

    return _rows(docs).mapInArrow(describe, SETS)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))


def frequency_levels(docs: DataFrame, similarity: Similarity) -> np.ndarray:
    """Rough frequency of the n-grams by the first bits of their hash, on a scale of a fifth more from level to level.

    Each task sends its counters in the narrowest type; their sums, of fixed size, go through the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for _, sets in _sets(batches, similarity.size):
            seen += np.bincount((np.concatenate(sets) >> U(64 - COUNTER_BITS)).astype(np.int64), minlength=len(seen))
        for part, counts in enumerate(np.split(seen, COUNTER_PARTS)):
            if counts.any():
                kind = np.min_scalar_type(int(counts.max()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([counts.astype(kind).tobytes()], pa.binary())],
                    ["part", "width", "counts"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], dtype=f"u{row['width']}").astype(np.int64)
                sums[row["part"]] = sums[row["part"]] + counts if row["part"] in sums else counts
        for part, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["part", "counts"])

    sent = docs.select("text").mapInArrow(count, "part int, width int, counts binary")
    sums = np.zeros((COUNTER_PARTS, (1 << COUNTER_BITS) // COUNTER_PARTS), dtype=np.int64)
    for row in sent.repartition("part").mapInArrow(total, "part int, counts binary").collect():  # one row per part
        sums[row["part"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return np.floor(4 * np.log2(sums.reshape(-1) + 1)).astype(np.uint8)


def set_fronts(docs: DataFrame, similarity: Similarity, levels: np.ndarray) -> DataFrame:
    """(key, id): the first n-grams of every set in the global order, with their place in the last byte of the key."""
    shared = share(docs.sparkSession, levels)  # one byte per counter
    fronts = Fronts(similarity.num, similarity.den)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for _, sets in _sets(batches, similarity.size):
            keys, ids, seen = [], [], set()
            for grams in sets:
                if len(grams) and (ident := _set_key(grams)) not in seen:
                    seen.add(ident)
                    size = fronts.size(len(grams))
                    order = (level[grams >> U(64 - COUNTER_BITS)].astype(U) << U(56)) | (grams & LOW_56)
                    first = np.sort(np.partition(order, size - 1)[:size])
                    keys.append((first & ~U(255)) | (np.arange(size, dtype=U) * U(256) // U(size)))
                    ids.append(np.full(size, ident, dtype=U))
            if keys:
                yield pa.RecordBatch.from_arrays([as_long(np.concatenate(x)) for x in (keys, ids)], ["key", "id"])

    return docs.select("text").mapInArrow(cut, "key long, id long")


def _grams(docs: DataFrame, wanted: np.ndarray, similarity: Similarity) -> DataFrame:
    """(id, fragment, grams) of the sets in the bitmap ``wanted``, partitioned by both; a repeated set comes once."""
    shared = share(docs.sparkSession, wanted)
    cuts = [U(((1 << 64) - 1) // COUNT_FRAGMENTS * f) for f in range(1, COUNT_FRAGMENTS)]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, similarity.size):
            ids = np.array([_set_key(s) if len(s) else 0 for s in sets], dtype=U)
            picked = in_bitmap(shared.value, ids.view(np.int64)) & np.array([len(s) > 0 for s in sets], dtype=bool)
            out: list[tuple] = []
            for i in np.flatnonzero(picked)[np.unique(ids[picked], return_index=True)[1]]:
                parts = np.split(sets[i], np.searchsorted(sets[i], cuts))
                out += [(ids[i].view(np.int64), f, part.view(np.int64)) for f, part in enumerate(parts)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)],
                    ["id", "fragment", "grams"],
                )

    rows = docs.select("text").mapInArrow(segments, "id long, fragment int, grams array<long>")
    return rows.repartition("id", "fragment").dropDuplicates(["id", "fragment"])


def _alike(pairs: DataFrame, wide: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that wide marks (id, wide) do not rule out; a set without wide marks is never ruled out."""
    num, den = similarity.num, similarity.den

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("wide_a", "wide_b", "n_a", "n_b"))
            kept = [
                a is None or b is None or odd_bits(a, b) * (den + num) <= (n_a + n_b) * (den - num) for a, b, n_a, n_b in zip(*columns, strict=True)
            ]
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(kept, pa.bool_()))

    a, b = (wide.select(F.col("id").alias(x), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    joined = pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
    return joined.mapInArrow(keep, "a long, b long, n_a long, n_b long")


def _components(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """(doc_id, text_key, n_shingles, root, component_id); root names the component and is null without words."""
    spark = docs.sparkSession
    sets = pin(document_sets(docs, similarity))
    fronts = Fronts(similarity.num, similarity.den)
    members = pin(fronts.members(set_fronts(docs, similarity, frequency_levels(docs, similarity))))
    free_shuffles(spark)
    described = sets.where("set_key IS NOT NULL").groupBy(F.col("set_key").alias("id")).agg(
        F.first("n_shingles").alias("n"), F.first("marks").alias("marks"), F.first("wide").alias("wide")  # the same in all rows of a key
    )
    near = members.select(F.explode(F.array("id", "centre")).alias("id")).distinct()
    described = pin(described.join(near, "id", "left_semi"))

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, n_a, n_b) that are links: overlaps by fragment, summed, where wide marks leave it open."""
        free_shuffles(spark)
        pairs = pin(_alike(pairs, described.where("wide IS NOT NULL").select("id", "wide"), similarity))
        free_shuffles(spark)
        grams = _grams(docs, bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id"))), similarity)
        a, b = (grams.select(F.col("id").alias(x), "fragment", F.col("grams").alias(f"grams_{x}")) for x in "ab")
        parts = pairs.withColumn("fragment", F.explode(F.array(*map(F.lit, range(COUNT_FRAGMENTS)))))
        partial = parts.join(a, ["a", "fragment"]).join(b, ["b", "fragment"]).select(
            "a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("overlap")
        )
        summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
        union = F.col("n_a") + F.col("n_b") - F.col("overlap")
        return summed.where(F.col("overlap") * similarity.den >= union * similarity.num).select("a", "b")

    roots = front_components(members, described.select("id", "n", "marks"), verify, fronts).withColumnRenamed("id", "set_key")
    named = pin(
        sets.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("low"))
        .join(roots, "set_key", "left")
        .select("set_key", "low", F.coalesce("root", "set_key").alias("root"))
    )
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "root").select("set_key", "root", "component_id")
    return sets.join(classes, "set_key", "left").select(
        "doc_id", "text_key", "n_shingles", "root",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def ngram_components(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text, ...).

    Rows link when their shingle sets have at least the given Jaccard similarity; all such links count, exactly.
    Equal sets form one class first, so copies never make pairs. Null and wordless texts have no shingles and link
    with nothing: their component is their own doc_id. A text with fewer words than a shingle has one. Repeated rows
    give repeated rows. component_id is the smallest doc_id of the component; a null id counts as none.
    """
    return _components(docs, similarity).select("doc_id", "n_shingles", "component_id")


def keep_one_per_component(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id (null last, then by text).

    Rows without words all stay. Of a stayer's repeated rows one stays. All columns are kept as they are.
    """
    found = pin(_components(docs, similarity).where("root IS NOT NULL"))
    rank = F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "text_key")
    first = found.groupBy("root").agg(F.min(rank).alias("first"))
    ident, key, copies, lost = free_names(docs, "_id", "_key", "_copies", "_lost")
    rows = found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias(copies))
    decided = pin(
        rows.join(first, "root")
        .select(F.col("doc_id").alias(ident), F.col("text_key").alias(key), copies, (rank != F.col("first")).alias(lost))
        .where(F.col(lost) | (F.col(copies) > 1))
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (text_key() == F.col(key))
    kept = docs.join(decided, same, "left_anti")
    repeated = decided.where(~F.col(lost))
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(repeated, same).dropDuplicates([ident, key]).select([f"`{c}`" for c in kept.columns]))
