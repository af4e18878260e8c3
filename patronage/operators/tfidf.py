"""Corpus TF-IDF over unigrams and bigrams as a long table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.numeric import round_half_up

#: Bytes of text whose terms are counted at once; words and pairs take some fifty times as much memory.
PIECE_BYTES = 4 << 20


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``PIECE_BYTES`` bytes of text, or of one row if it is longer."""
    for batch in batches:
        ends, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _kept_words(texts: pa.Array, stop_words: Sequence[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts, and row and word of every occurrence that counts, in order.

    Words of two letters or more count; stop words go before neighbours are paired. A null text has none.
    """
    lists = pc.split_pattern(texts, " ")
    found = pc.list_flatten(lists).dictionary_encode()
    kept = pc.and_(pc.greater_equal(pc.utf8_length(found.dictionary), 2), pc.invert(pc.is_in(found.dictionary, value_set=pa.array(stop_words, pa.string()))))
    row, word = pc.list_parent_indices(lists).to_numpy().astype(np.int64), found.indices.to_numpy().astype(np.int64)
    keep = kept.to_numpy(zero_copy_only=False).astype(bool)[word]
    return found.dictionary, row[keep], word[keep]


def _one_two(row: np.ndarray, word: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every word, ``word * base``, and of every two neighbours a and b, ``a * base + b + 1``."""
    pair = np.flatnonzero(row[1:] == row[:-1])
    return np.append(row, row[pair]), np.append(word * base, word[pair] * base + word[pair + 1] + 1)


def _counted(term: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and number of occurrences of the term in the row."""
    cells, n = np.unique(term * rows + row, return_counts=True)
    return cells // rows, cells % rows, n


def vocabulary(
    docs: DataFrame, cleaned: str, stop_words: Sequence[str], n_docs: Column, min_df: int, max_df: float, max_features: int
) -> DataFrame:
    """The most frequent terms with a document count in range: (term, df), at most ``max_features`` rows.

    A document is one row, so its distinct terms are known there: tasks fold the terms of a piece of their rows, one grouping
    by term gives both counts, and no (document, term) pair is shuffled.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            names, row, word = _kept_words(batch.column("text"), stop_words)
            base = len(names) + 1
            row, term = _one_two(row, word, base)
            distinct, place = np.unique(term, return_inverse=True)
            at, _, n = _counted(place, row, len(batch))
            first, second = names.take(pa.array(distinct // base)), distinct % base - 1
            both = pc.binary_join_element_wise(first, names.take(pa.array(np.maximum(second, 0))), " ")
            totals = np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(pa.array(second >= 0), both, first), pa.array(totals), pa.array(np.bincount(at, minlength=len(distinct)))], ["term", "tf", "df"]
            )

    folded = docs.select(F.col(cleaned).cast("string").alias("text")).mapInArrow(fold, "term string, tf long, df long")
    stats = folded.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total"))
    in_range = (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs)
    return stats.where(in_range).orderBy(F.desc("total"), "term").limit(max_features).select("term", "df")


def known_terms(docs: DataFrame, key: str, cleaned: str, stop_words: Sequence[str], terms: Sequence[tuple[str, int]]) -> DataFrame:
    """(key, term, df, tf): how often each row has each of the ``terms`` (term, df), which go to the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, dfs = pa.array([t for t, _ in shared.value], pa.string()), pa.array([n for _, n in shared.value], pa.int64())
        parts = [t.split(" ") for t, _ in shared.value]
        single = {w: i for i, w in enumerate(sorted({w for p in parts for w in p}))}
        base, inside = len(single) + 1, pa.array(list(single), pa.string())
        numbers = np.array([single[p[0]] * base + (single[p[1]] + 1 if len(p) > 1 else 0) for p in parts], dtype=np.int64)
        order = np.argsort(numbers)
        for batch in _pieces(batches):
            own, row, word = _kept_words(batch.column("text"), stop_words)
            # a word outside stays in the row, so that its neighbours do not become a pair
            word = pc.fill_null(pc.index_in(own, value_set=inside), -1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
            pair = np.flatnonzero((row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))
            term = np.append(word[word >= 0] * base, word[pair] * base + word[pair + 1] + 1)
            row = np.append(row[word >= 0], row[pair])
            at = np.minimum(np.searchsorted(numbers, term, sorter=order), max(len(numbers) - 1, 0))
            hit = numbers[order][at] == term if len(numbers) else np.zeros(len(term), dtype=bool)
            found, rows, n = _counted(order[at[hit]], row[hit], len(batch))
            found = pa.array(found)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), names.take(found), dfs.take(found), pa.array(n)], ["key", "term", "df", "tf"])

    rows = docs.select(F.col(key).alias("key"), F.col(cleaned).cast("string").alias("text"))
    counted = rows.mapInArrow(count, rows.select("key").schema.add("term", "string").add("df", "long").add("tf", "long"))
    return counted.withColumnRenamed("key", key)


def tfidf(
    docs: DataFrame, key: str, cleaned: str = "clean_text", stop_words: Sequence[str] | None = None,
    min_df: int = 10, max_df: float = 0.90, max_features: int = 5000, sublinear: bool = False,
) -> DataFrame:
    """(key, term, weight) with smoothed idf ln((1+N)/(1+df))+1 and rows scaled to unit length.

    The vocabulary is bounded by ``max_features`` and sent to the tasks; only its terms are shuffled.
    """
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    stop_words = english_stop_words() if stop_words is None else list(stop_words)
    terms = vocabulary(docs, cleaned, stop_words, n_docs, min_df, max_df, max_features)
    known = known_terms(docs, key, cleaned, stop_words, [tuple(r) for r in terms.collect()])  # at most max_features
    # dealt out once: all later steps keep the rows of a key where they are
    counts = known.repartition(key).groupBy(key, "term", "df").agg(F.sum("tf").alias("tf"))
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    tf = F.lit(1.0) + F.log(F.col("tf")) if sublinear else F.col("tf").cast("double")
    weighted = counts.select(key, "term", (tf * idf).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("_w") / norm).alias("weight"))


def top_terms(weights: DataFrame, n_docs: Column, k: int = 100, digits: int = 9) -> DataFrame:
    """Terms with the largest mean weight over all documents (those without the term count as zero)."""
    means = weights.groupBy("term").agg(F.sum("weight").alias("_s"))
    scored = means.select("term", round_half_up(F.col("_s") / n_docs, digits).alias("tfidf_score"))
    return scored.orderBy(F.desc("tfidf_score"), "term").limit(k)


def corpus_terms(docs: DataFrame, key: str, k: int = 100, **options) -> DataFrame:
    """Top TF-IDF terms of a corpus."""
    return top_terms(tfidf(docs, key, **options), docs.agg(F.count(F.lit(1))).scalar(), k)


def negative_terms(scored: DataFrame, key: str, k: int = 100, min_docs: int = 10, **options) -> DataFrame:
    """Top terms of the negative documents; empty when there are fewer than ``min_docs``."""
    negative = scored.where(F.col("sentiment") == "Negative")
    n = negative.agg(F.count(F.lit(1))).scalar()
    found = corpus_terms(negative, key, k, **{"min_df": 5, "max_df": 0.95, **options})
    return found.where(n >= min_docs)
