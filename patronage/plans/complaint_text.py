"""The complaint chain: texts -> cleaned texts -> TF-IDF -> topics and word vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.functions import text
from patronage.operators import complaints as cx, tfidf, vectors
from patronage.plans.stages import stage
from patronage.sources import tables

MIN_TEXT = 20


def build_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Complaints with cleaned text and the length of the raw one: the patterns run once, without a shuffle."""

    def build() -> DataFrame:
        cleaned = cx.with_clean_text(tables.complaints(spark, folder, False))
        return cleaned.withColumn("text_length", F.length(cx.TEXT).cast("long")).drop(cx.TEXT)

    return stage(spark, folder, "cleaned", build)


def build_sentiment(
    spark: SparkSession, folder: str, positive: Sequence[str], negative: Sequence[str]
) -> DataFrame:
    """Lexicon sentiment per complaint with its response. The texts are dropped before the join."""
    scored = cx.with_sentiment(build_cleaned(spark, folder), positive, negative).drop("clean_text", "text_length")
    return tables.with_responses(scored, spark, folder)


def build_themed(
    spark: SparkSession, folder: str, positive: Sequence[str], negative: Sequence[str], topics: DataFrame | None = None
) -> DataFrame:
    """Theme, response and raw-word sentiment per complaint, without the texts.

    Topics come from ``topics`` (complaint_id, dominant_topic) of a fitted model, else from the length of the text;
    complaints that the model did not see have no topic.
    """

    def build() -> DataFrame:
        texts = tables.complaints(spark, folder, False)
        if topics is not None:
            texts = tables.dealt(texts.drop("dominant_topic"))
        scored = cx.with_raw_sentiment(texts, positive, negative).drop(cx.TEXT)
        if topics is not None:
            scored = scored.join(topics.select("complaint_id", "dominant_topic"), "complaint_id", "left")
        return cx.with_theme(tables.with_responses(scored, spark, folder))

    if topics is not None:
        return build()
    return stage(spark, folder, f"themed {sorted(positive)} {sorted(negative)}", build)


def build_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cleaned of redactions, long enough for topics."""

    def build() -> DataFrame:
        kept = F.filter(F.array(text.clean_redacted(cx.TEXT)), lambda t: F.length(t) >= MIN_TEXT)
        return tables.dealt(tables.complaints(spark, folder, False).select("complaint_id", cx.TEXT)).select("complaint_id", F.explode(kept).alias("clean_text"))

    return stage(spark, folder, "redacted", build)


def build_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Token lists for word vectors, which the trainer reads many times."""
    return stage(
        spark, folder, "sentences",
        lambda: vectors.sentences(tables.complaints(spark, folder, False), "complaint_id", cx.TEXT),
    )


def build_topic_weights(spark: SparkSession, folder: str, stop_words: Sequence[str], **options) -> DataFrame:
    """Sub-linear TF-IDF rows of the redaction-free texts."""
    return tfidf.tfidf(
        build_redacted(spark, folder), "complaint_id", stop_words=stop_words, sublinear=True,
        **{"min_df": 15, "max_df": 0.90, "max_features": 10_000, **options},
    )
