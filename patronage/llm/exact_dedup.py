"""Exact deduplication by an extendible-hash index on shared files.

Every text has a 64-bit key. A directory maps the leading bits of a key to a bucket; a bucket with more bytes than
its capacity is split by the next bit, and where that bit is beyond the directory's depth the directory doubles.
The index is a stored table with the texts, laid out by bucket, each bucket (a range of keys) in one file.
The task that owns a file reads its entries in key order, chains entries of equal keys and compares their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from patronage.llm.linking import share
from patronage.llm.textops import small_batches
from patronage.session import ensure_checkpoint_dir, pin


@dataclass(frozen=True)
class Layout:
    """Bytes of text in a bucket before it splits, leading bits counted in one round, and the largest depth.

    The directory has at most 2 ** max_depth entries of 4 bytes; buckets that would need more stay overfull and are
    read as the same stream, so nothing depends on their size.
    """

    capacity: int = 4 << 20
    step: int = 4
    max_depth: int = 20


def _normal(text) -> bytes:
    return text.as_py().encode().lower()  # bytes.lower() changes A-Z only


def _row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = [_normal(t) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["doc_id", "key", "text_sha256", "bytes"],
        )


def directory(loads: DataFrame, layout: Layout) -> tuple[int, np.ndarray]:
    """Depth and bucket numbers by leading bits, from (key, bytes) with one row per key.

    Each round counts the bytes below the buckets that are still overfull, ``step`` bits deeper, and splits them.
    """
    depth, leaves, overfull = 0, [], [0]
    while True:
        deeper = min(depth + layout.step, layout.max_depth)
        if depth == deeper:
            leaves += [(depth, p) for p in overfull]
            break
        at = [F.shiftrightunsigned("key", 64 - d) if d else F.lit(0).cast("long") for d in (depth, deeper)]
        # at most 2 ** max_depth rows in all rounds together
        counted = loads.where(at[0].isin(overfull)).groupBy(at[1].alias("prefix")).agg(F.sum("bytes").alias("bytes")).collect()
        load = {(deeper, r["prefix"]): r["bytes"] for r in counted}
        for d in range(deeper - 1, depth - 1, -1):
            for (level, p), n in [x for x in load.items() if x[0][0] == d + 1]:
                load[d, p >> 1] = load.get((d, p >> 1), 0) + n
        still = []
        stack = [(depth, p) for p in overfull]
        while stack:
            d, p = stack.pop()
            if load.get((d, p), 0) <= layout.capacity:
                leaves.append((d, p))
            elif d == deeper:
                still.append(p)
            else:
                stack += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        depth, overfull = deeper, still
        if not overfull:
            break
    depth = max(d for d, _ in leaves)
    table = np.zeros(1 << depth, dtype=np.int32)
    for number, (d, p) in enumerate(sorted(leaves, key=lambda x: x[1] << (depth - x[0]))):
        table[p << (depth - d):(p + 1) << (depth - d)] = number
    return depth, table


def _entries(docs: DataFrame, depth: int, table: np.ndarray) -> DataFrame:
    """(bucket, key, text, copies, keep_id): equal texts of a batch are one entry, so a hot text leaves a task as a few rows."""
    shared = share(docs.sparkSession, table)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found: dict[bytes, list] = {}
            for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                entry = found.setdefault(_normal(text), [0, None])
                entry[0] += 1
                entry[1] = ident if entry[1] is None or (ident is not None and ident > entry[1]) else entry[1]
            keys = np.array([xxhash.xxh3_64_intdigest(t) for t in found], dtype=np.uint64)
            places = (keys >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(keys), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shared.value[places]), pa.array(keys.view(np.int64)), pa.array(list(found), pa.binary()),
                    pa.array([e[0] for e in found.values()], pa.int64()), pa.array([e[1] for e in found.values()], pa.int64()),
                ],
                ["bucket", "key", "text", "copies", "keep_id"],
            )

    return docs.mapInArrow(fold, "bucket int, key long, text binary, copies long, keep_id long")


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal texts from entries in key order; only the chain of the current key is held."""
    last, chain = None, {}

    def groups() -> pa.RecordBatch:
        rows = [(last, hashlib.sha256(t).hexdigest(), *e) for t, e in chain.items()]
        columns = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "text_sha256", "group_size", "keep_id"])

    done: list[pa.RecordBatch] = []
    for batch in batches:
        for key, text, copies, keep in zip(*(batch.column(c) for c in ("key", "text", "copies", "keep_id")), strict=True):
            if (key := key.as_py()) != last:
                if chain:
                    done.append(groups())
                last, chain = key, {}
            # a dictionary of bytes: entries of one key are told apart by comparing their bytes
            entry = chain.setdefault(text.as_py(), [0, None])
            entry[0] += copies.as_py()
            if (keep := keep.as_py()) is not None:
                entry[1] = keep if entry[1] is None else max(entry[1], keep)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done = []
    if chain:
        yield groups()


def exact_groups(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of (doc_id, text, ...).

    Texts are equal when identical after lower-casing A-Z; a null text is empty, and empty texts are a group as any
    other. The largest doc_id of a group stays; a null id is below all others, and a group of null ids has keep_id
    null. Rows that repeat the id that stays are all marked kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = pin(rows.mapInArrow(_row_keys, "doc_id long, key long, text_sha256 string, bytes long"))
    loads = pin(keyed.groupBy("key").agg(F.max("bytes").alias("bytes")))
    depth, table = directory(loads, layout)
    files = int(table[-1]) + 1
    # one file for each bucket while they are few; beyond that each file holds several whole buckets
    files = min(files, max(1, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    name = f"extendible_index_{uuid.uuid4().hex}"
    (
        _entries(rows, depth, table).repartition(files, "bucket")
        .write.bucketBy(files, "bucket").sortBy("bucket", "key").option("path", path).saveAsTable(name)
    )
    # ranked by bucket, so that Spark reads each bucket whole in one task, from the owner's file and without a shuffle
    owner = Window.partitionBy("bucket").orderBy("key")
    ordered = spark.table(name).select("key", "text", "copies", "keep_id", F.row_number().over(owner).alias("place"))
    groups = pin(ordered.mapInArrow(_chains, "key long, text_sha256 string, group_size long, keep_id long"))
    spark.sql(f"DROP TABLE {name}")
    joined = keyed.join(groups, ["key", "text_sha256"])
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
