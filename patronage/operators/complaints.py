"""Complaint intake, sentiment, themes and theme priority."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.fixed_values import (
    COMPLAINT_COLUMN_NAMES, COMPLAINT_COLUMNS, ID_CANDIDATES, NARRATIVE_CANDIDATES, NEGATIVE_WORDS, OTHER_THEME,
    POSITIVE_WORDS, PRIORITY_EDGES, PRIORITY_LABELS, THEMES,
)
from patronage.functions.numeric import is_yes, non_blank, pct, ratio
from patronage.functions.rules import label_map, right_closed_bins
from patronage.functions.text import clean_text, lexicon_score, polarity, raw_words, words
from patronage.operators.cleaning import dedup_keep_first
from patronage.operators.ranking import first_per_group, histogram, min_max, quantiles
from patronage.sources.readers import first_present, keep_available, require_columns

TEXT = "complaint_what_happened"


def prepare_complaints(raw: DataFrame, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows with a narrative, one per complaint id, under snake-case names.

    ``order`` decides which copy of an id stays and, with ``limit``, which usable rows are taken.
    """
    narrative = first_present(raw, NARRATIVE_CANDIDATES)
    if narrative is None:
        raise ValueError(f"no narrative column among {raw.columns}")
    usable = raw.where(non_blank(F.col(f"`{narrative}`")))
    if limit is not None:
        usable = usable.orderBy(*order).limit(limit)
    id_column = first_present(raw, ID_CANDIDATES)
    if id_column is not None:
        usable = dedup_keep_first(usable, [f"`{id_column}`"], list(order))
    return usable.withColumnsRenamed(COMPLAINT_COLUMN_NAMES)


def complaint_view(complaints: DataFrame) -> DataFrame:
    """The known complaint columns that are there, for rows with a narrative."""
    return keep_available(complaints.where(non_blank(TEXT)), COMPLAINT_COLUMNS)


def channel_sample(complaints: DataFrame, channel: str, order: Sequence[str], per_channel: int = 5000) -> DataFrame:
    """The first rows of every channel, exactly."""
    usable = complaints.where(non_blank(TEXT) & F.col(channel).isNotNull())
    return first_per_group(usable, [channel], order, per_channel)


def channel_counts(complaints: DataFrame, channel: str) -> DataFrame:
    usable = complaints.where(non_blank(TEXT))
    return usable.groupBy(F.coalesce(F.col(channel), F.lit("Unknown")).alias(channel)).agg(
        F.count(F.lit(1)).alias("complaints")
    )


def with_clean_text(complaints: DataFrame) -> DataFrame:
    """Add ``clean_text`` and drop complaints that have nothing left.

    The empty text is dropped as an empty list is exploded; as a separate filter the cleaning would be
    pushed below it and run twice.
    """
    kept = F.filter(F.array(clean_text(TEXT)), lambda t: t != "")
    return complaints.withColumn("clean_text", F.explode(kept))


def text_measures(cleaned: DataFrame) -> DataFrame:
    """Raw length and words of the cleaned text; a stored stage holds ``text_length`` in place of the raw text."""
    length = F.col("text_length") if "text_length" in cleaned.columns else F.length(TEXT)
    return cleaned.withColumns({"text_length": length.cast("long"), "word_count": F.size(words("clean_text")).cast("long")})


def text_statistics(cleaned: DataFrame) -> DataFrame:
    """Complaints, mean and exact median of words, mean and exact median of raw length."""
    measured = text_measures(cleaned).select("text_length", "word_count")
    hist = histogram(measured, ["text_length", "word_count"])
    mean = hist.rows.groupBy("metric").agg(
        ratio(F.sum(F.col("value").cast("decimal(20,0)") * F.col("cnt")), F.sum("cnt")).alias("mean")
    )
    out = quantiles(hist, [0.5]).join(mean, "metric")
    return out.select("metric", "n", "min", "max", "mean", F.col("q")[0].alias("median"))


def with_sentiment(
    cleaned: DataFrame, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> DataFrame:
    """Lexicon score and label over the words of the cleaned text."""
    score = lexicon_score(words("clean_text"), positive, negative)
    return cleaned.withColumn("sentiment_score", score).withColumn("sentiment", polarity(F.col("sentiment_score")))


def with_raw_sentiment(
    complaints: DataFrame, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> DataFrame:
    """Lexicon label over raw words, where a word with punctuation does not match."""
    return complaints.withColumn("sentiment", polarity(lexicon_score(raw_words(TEXT), positive, negative)))


def sentiment_by(scored: DataFrame, *keys: str, positive: bool = False) -> DataFrame:
    """Complaints (with an id), negative (and positive) complaints and negative rate; null groups stay."""
    counts = [F.count(F.when(F.col("sentiment") == "Negative", 1)).alias("negative_complaints")]
    if positive:
        counts.append(F.count(F.when(F.col("sentiment") == "Positive", 1)).alias("positive_complaints"))
    groups = scored.groupBy(*keys).agg(F.count("complaint_id").alias("complaints"), *counts)
    return groups.withColumn("negative_rate", pct(F.col("negative_complaints"), F.col("complaints")))


def with_theme(complaints: DataFrame) -> DataFrame:
    """Theme of the dominant topic and the response flags."""
    require_columns(complaints, ["dominant_topic", "timely_response"])
    topic = F.col("dominant_topic").cast("string").try_cast("double")
    return complaints.withColumns(
        {
            "theme": label_map(topic, THEMES, OTHER_THEME),
            "timely_yes": is_yes("timely_response"),
            "not_timely": ~is_yes("timely_response"),
        }
    )


def theme_metrics(themes: DataFrame) -> DataFrame:
    """Volume, sentiment and response rates per theme."""
    groups = themes.groupBy("theme").agg(
        F.count(F.lit(1)).alias("complaints"),
        F.count(F.when(F.col("sentiment") == "Negative", 1)).alias("negative_complaints"),
        F.count(F.when(F.col("sentiment") == "Positive", 1)).alias("positive_complaints"),
        F.count(F.when(F.col("timely_yes"), 1)).alias("timely_responses"),
    )
    n = F.col("complaints")
    return groups.withColumns(
        {
            "negative_rate": pct(F.col("negative_complaints"), n),
            "positive_rate": pct(F.col("positive_complaints"), n),
            "timely_response_rate": pct(F.col("timely_responses"), n),
            "volume_share": pct(n, F.sum(n).over(Window.partitionBy())),  # one row per theme
        }
    )


def theme_priority(metrics: DataFrame, weights: tuple[float, float, float] = (0.40, 0.40, 0.20)) -> DataFrame:
    """Weighted score of scaled volume, negative rate and response gap, with rank and tier."""
    volume, negative, gap = (F.lit(w) for w in weights)
    scored = metrics.withColumns(
        {
            "volume_score": min_max(F.col("complaints").cast("double")),
            "negative_score": min_max("negative_rate"),
            "response_gap_score": min_max(F.lit(100.0) - F.col("timely_response_rate")),
        }
    ).withColumn(
        "cx_priority_score",
        (volume * F.col("volume_score") + negative * F.col("negative_score") + gap * F.col("response_gap_score"))
        * F.lit(100.0),
    )
    best_first = Window.partitionBy().orderBy(F.desc("cx_priority_score"))  # one row per theme
    return scored.withColumn("priority_rank", F.rank().over(best_first)).withColumn(
        "priority_tier", right_closed_bins("cx_priority_score", PRIORITY_EDGES, PRIORITY_LABELS)
    )


def priority_kpis(priorities: DataFrame) -> DataFrame:
    """Complaints, high-priority themes and the theme on top."""
    top = F.min(F.struct((-F.col("cx_priority_score")).alias("s"), F.col("theme").alias("t")))
    return priorities.agg(
        F.sum("complaints").alias("total_complaints"),
        F.count(F.when(F.col("priority_tier") == "High Priority", 1)).alias("high_priority_themes"),
        top.alias("_top"),
    ).select(
        "total_complaints", "high_priority_themes", F.col("_top.t").alias("top_theme"), (-F.col("_top.s")).alias("top_score")
    )


def theme_by(themes: DataFrame, dim: str) -> DataFrame:
    """Complaints and negative rate per (dimension, theme)."""
    groups = themes.groupBy(dim, "theme").agg(
        F.count(F.lit(1)).alias("complaints"),
        F.count(F.when(F.col("sentiment") == "Negative", 1)).alias("negative_complaints"),
    )
    return groups.withColumn("negative_rate", pct(F.col("negative_complaints"), F.col("complaints")))


def share_within(
    df: DataFrame, parent: str, child: str, share: str, count: str = "complaints", total: str | None = None
) -> DataFrame:
    """Counts per (parent, child) and the share of the parent total; a null parent has no share."""
    counts = df.groupBy(parent, child).agg(F.count(F.lit(1)).alias(count))
    whole = F.when(F.col(parent).isNotNull(), F.sum(count).over(Window.partitionBy(parent)))
    named = counts.withColumn(total or "_total", whole)
    out = named.withColumn(share, pct(F.col(count), F.col(total or "_total")))
    return out if total else out.drop("_total")


def topic_distribution(df: DataFrame, topic: str = "dominant_topic") -> DataFrame:
    """Complaints per topic and their share of all rows, in topic order."""
    counts = df.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic_id")).agg(
        F.count(F.lit(1)).alias("complaints")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("percentage", pct(F.col("complaints"), total)).orderBy("topic_id")


Predict = Callable[[list[str]], list[tuple[str, float]]]


@dataclass(frozen=True)
class Predictor:
    """A classifier that tasks load themselves: ``load`` returns the function from texts to (label, confidence).

    A Python worker loads it once and keeps it under ``name``, whatever the number of its tasks and batches. The model
    itself is not part of a task: ``load`` should read it from where all executors can.
    """

    name: str
    load: Callable[[], Predict]


_loaded: dict[str, Predict] = {}


def loaded(predictor: Predictor) -> Predict:
    """The predictor of this Python worker."""
    if predictor.name not in _loaded:
        _loaded[predictor.name] = predictor.load()
    return _loaded[predictor.name]


def classify_texts(
    complaints: DataFrame, predictor: Predictor, keep: Sequence[str], batch_size: int = 8, limit: int | None = None,
    order: Sequence[str] = (), max_chars: int | None = None,
) -> DataFrame:
    """Label and confidence of every non-blank text, ``batch_size`` texts to a call of the predictor.

    By default every row and the whole text are classified; ``limit`` and ``max_chars`` are there for slow models.
    """
    rows = complaints.where(non_blank(TEXT))
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    text = F.trim(TEXT) if max_chars is None else F.substring(F.trim(TEXT), 1, max_chars)
    rows = keep_available(rows.withColumn("_text", text), [*keep, "_text"])
    kept = [f.name for f in rows.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = loaded(predictor)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            found = [p for i in range(0, len(texts), batch_size) for p in predict(texts[i : i + batch_size].to_pylist())]
            labels = [pa.array([p[0] for p in found], pa.string()), pa.array([float(p[1]) for p in found], pa.float64())]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *labels], [*kept, "predicted_label", "confidence"])

    schema = rows.select(*kept).schema.add("predicted_label", "string").add("confidence", "double")
    labelled = rows.mapInArrow(run, schema)
    names = {"POSITIVE": "Positive", "NEGATIVE": "Negative"}
    return labelled.withColumn("sentiment", label_map("predicted_label", names, "Neutral"))


def classification_summary(classified: DataFrame) -> DataFrame:
    """Complaints, share and mean confidence per label."""
    groups = classified.groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("complaints"), F.avg("confidence").alias("mean_confidence")
    )
    share = pct(F.col("complaints"), F.sum("complaints").over(Window.partitionBy()))  # three rows
    return groups.withColumn("percentage", share)


def response_performance(themes: DataFrame, dim: str = "product") -> DataFrame:
    """Timely and late response rates per product; a null product is its own group."""
    groups = themes.groupBy(dim).agg(
        F.count(F.lit(1)).alias("complaints"), F.count(F.when(F.col("timely_yes"), 1)).alias("timely_responses")
    )
    timely: Column = pct(F.col("timely_responses"), F.col("complaints"))
    return groups.withColumn("timely_rate_pct", timely).withColumn(
        "not_timely_rate_pct", F.lit(100.0) - F.col("timely_rate_pct")
    )
