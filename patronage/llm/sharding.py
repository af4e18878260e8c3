"""Sharding by a Feistel permutation of global row numbers.

Rows get global numbers that depend on the data alone, a keyed permutation of [0, n) shuffles the numbers, and
shard and slot are the remainder and the quotient by the shard count. The permutation can be computed, and turned
back, for any single row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from patronage.llm.linking import text_key
from patronage.llm.textops import U, mix, mix_one
from patronage.session import pin

#: Parts in which rows are numbered: this many counts reach the driver.
PARTS = 4096


@dataclass(frozen=True)
class Feistel:
    """A permutation of [0, n): a balanced Feistel network on the next even number of bits, walked until below n."""

    n: int
    seed: int = 0
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> list[np.uint64]:
        return [U(mix_one(self.seed * 1_000_003 + r + 1)) for r in range(self.rounds)]

    def _pass(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        mask, half = U((1 << self.half) - 1), U(self.half)
        left, right = x >> half, x & mask
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (mix(left + key) & mask), left
            else:
                left, right = right, left ^ (mix(right + key) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys, out = self._keys(), self._pass(np.asarray(x).astype(U), self._keys(), back)
        while (outside := out >= U(self.n)).any():
            out[outside] = self._pass(out[outside], keys, back)
        return out.astype(np.int64)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Where rows go."""
        return self._walk(x, False)

    def row(self, x: np.ndarray) -> np.ndarray:
        """The rows at given places."""
        return self._walk(x, True)


def parts(rows: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """Adds ``part`` and the row's ``rank`` in it; also the number of rows before each part, and of all rows.

    Rows are dealt to ``PARTS`` parts by a hash of (doc_id, text key), counted, and ranked by both inside their part, so
    the number of a row (rows before its part + rank) depends on the data alone. Rows equal in both are interchangeable.
    """
    placed = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(PARTS)).cast("int"))
    counts = np.zeros(PARTS, dtype=np.int64)
    for part, count in placed.groupBy("part").count().collect():
        counts[part] = count
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "text_key")
    ranked = placed.withColumn("rank", (F.row_number().over(inside) - 1).cast("long"))
    return ranked, np.cumsum(counts) - counts, int(counts.sum())


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of (doc_id, text, ...).

    The law is ``rows``: counts differ by one at most, and slots run from 0 without gaps; grown_shard is null. Size is
    the text's UTF-8 bytes plus 16; a null text has no bytes and the checksum 0. The result depends on the rows alone,
    not on partitions or order; repeated rows take different places. An empty table gives an empty result.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = pin(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), text_key().alias("text_key"),
    ))
    ranked, before, n = parts(rows)
    feistel = Feistel(max(n, 1), seed)

    @F.arrow_udf("long")
    def place(part: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.array(feistel.place(before[part.to_numpy()] + rank.to_numpy()))

    placed = ranked.withColumn("_place", place("part", "rank"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_place DIV {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
