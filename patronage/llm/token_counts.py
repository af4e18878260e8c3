"""Token counts by a digest cache.

The cache is a Parquet table of (digest, n_tokens) with one folder for each tokenizer version. A text is known by the
SHA-256 of its normalised content (a null text is empty). Digests are joined to the stored counts; each distinct digest
that is missing is encoded once, wherever and however often its text occurs, and appended. Entries depend on digest and
version alone, so a lost executor, a repeated task or a second writer can at worst store an entry twice; readers fold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patronage.llm.linking import share
from patronage.llm.textops import small_batches
from patronage.llm.tokens import Vocabulary, count_tokens
from patronage.session import pin

ENTRY = "digest binary, n_tokens long"
#: Missing digests that are broadcast to pick their texts (32 bytes each); with more, texts are folded by digest first.
FEW = 50_000
#: Digests with at least this part of all rows get their count by broadcast; there are at most as many.
HOT_PARTS = 1000
#: Bytes of text that a task encodes at a time.
ENCODED_BYTES = 2 << 20


def _folder(cache: str, vocabulary: Vocabulary) -> str:
    return f"{cache.rstrip('/')}/version={vocabulary.version}"


def stored_counts(spark: SparkSession, cache: str, vocabulary: Vocabulary) -> DataFrame:
    """(digest, n_tokens) of the cache for this version, each digest once; empty where nothing is stored yet."""
    folder = _folder(cache, vocabulary)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _body() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _digest() -> Column:
    return F.unhex(F.sha2(_body(), 256))


def encode_texts(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(digest, text) -> (digest, n_tokens), by the tokenizer's library."""
    shared = share(texts.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=ENCODED_BYTES):
            counts = pa.array(count_tokens(batch.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(encode, ENTRY)


def _texts_of(docs: DataFrame, misses: DataFrame) -> DataFrame:
    """(digest, text) of the missing digests, each once. Copies in one task are folded before the shuffle, however hot."""
    keyed = docs.select(_digest().alias("digest"), _body().alias("text"))
    few = misses.limit(FEW + 1).count() <= FEW
    chosen = keyed.join(F.broadcast(misses), "digest", "left_semi") if few else keyed
    once = chosen.groupBy("digest").agg(F.first("text").alias("text"))
    return once if few else once.join(misses, "digest", "left_semi")


def append_missing(docs: DataFrame, digests: DataFrame, vocabulary: Vocabulary, cache: str) -> None:
    """Encodes the texts of ``docs`` whose digests (digest) the cache lacks, and appends their counts."""
    misses = pin(digests.select("digest").join(stored_counts(docs.sparkSession, cache, vocabulary), "digest", "left_anti"))
    if not misses.isEmpty():
        encode_texts(_texts_of(docs, misses), vocabulary).write.mode("append").parquet(_folder(cache, vocabulary))


def count_documents(docs: DataFrame, vocabulary: Vocabulary, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of (doc_id, text, ...), in tokens of ``vocabulary``.

    Tokens are the library's for the whole text, without begin, end or added special tokens, cut or padding; a null text
    is empty and has none. Equal texts have equal counts whatever their ids; repeated rows and null ids stay. Very long
    texts are encoded whole. Other columns are not read. An empty table gives an empty result and an untouched cache.
    ``cache`` is a folder that all executors share.
    """
    spark = docs.sparkSession
    keyed = pin(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(_body()).cast("long").alias("n_bytes"), _digest().alias("digest"),
    ))
    sizes = pin(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")))
    append_missing(docs, sizes, vocabulary, cache)
    counts = stored_counts(spark, cache, vocabulary)
    rows = keyed.count()
    hot = counts.join(sizes.where(F.col("copies") * HOT_PARTS >= max(rows, 2 * HOT_PARTS)).select("digest"), "digest", "left_semi")
    hot = pin(hot)
    known = keyed.join(F.broadcast(hot.withColumnRenamed("n_tokens", "hot_tokens")), "digest", "left")
    return (
        known.where("hot_tokens IS NOT NULL").select("doc_id", "n_bytes", F.col("hot_tokens").alias("n_tokens"))
        .unionByName(known.where("hot_tokens IS NULL").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens"))
    )
