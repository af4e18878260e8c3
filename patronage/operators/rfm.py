"""RFM scores, segments and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from patronage.functions.fixed_values import SEGMENT_ACTIONS
from patronage.functions.numeric import exact_avg, money_sum, money_total, pct, ratio, round_half_up
from patronage.functions.rules import first_match, label_map
from patronage.operators.ranking import Histogram, quantile_scores

RFM_INPUTS = {
    "r_score": ("recency_days", False),
    "f_score": ("total_invoices", True),
    "m_score": ("total_revenue", True),
}


def segment_rules():
    """Ten segments; the first rule that holds decides."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return [
        ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
        ((r <= 2) & (f >= 4) & (m >= 4), "Cannot Lose"),
        ((r >= 3) & (f >= 4) & (m >= 3), "Loyal Customers"),
        ((m >= 5) & (f <= 3), "Big Spenders"),
        ((r <= 2) & (f >= 3) & (m >= 3), "At Risk"),
        ((r >= 4) & f.between(2, 3), "Potential Loyalists"),
        ((r >= 4) & (f == 1), "New Customers"),
        ((r <= 2) & (f <= 2), "Hibernating"),
        (F.col("rfm_total_score") <= 6, "Low Value"),
    ]


def assign_segments(scored: DataFrame) -> DataFrame:
    """Composite scores, segment and action for rows that have r, f and m scores."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (
        scored.withColumn("rfm_score", F.concat(*[c.cast("string") for c in (r, f, m)]))
        .withColumn("rfm_total_score", (r + f + m).cast("int"))
        .withColumn("rfm_average_score", ratio(F.col("rfm_total_score"), F.lit(3)))
        .withColumn("rfm_segment", first_match(segment_rules(), "Needs Attention"))
        .withColumn("recommended_action", label_map("rfm_segment", SEGMENT_ACTIONS))
    )


def rfm_segments(features: DataFrame, hist: Histogram | None = None) -> DataFrame:
    """Features plus eight RFM columns. ``features`` should be stored: it is read more than once."""
    return assign_segments(quantile_scores(features, "customer_id", RFM_INPUTS, hist))


def segment_summary(rfm: DataFrame) -> DataFrame:
    """Customers, revenue and averages per segment with shares of the total."""
    groups = rfm.groupBy("rfm_segment").agg(
        F.count("customer_id").alias("customer_count"),
        money_sum("total_revenue").alias("_revenue"),
        exact_avg("total_revenue").alias("_avg_revenue"),
        exact_avg("recency_days").alias("_avg_recency"),
        exact_avg("total_invoices").alias("_avg_invoices"),
    )
    total = Window.partitionBy()  # ten rows at most
    return groups.select(
        "rfm_segment",
        "customer_count",
        round_half_up(pct(F.col("customer_count"), F.sum("customer_count").over(total)), 2).alias("customer_percent"),
        round_half_up(F.col("_revenue"), 2).alias("total_revenue"),
        round_half_up(F.col("_avg_revenue"), 2).alias("avg_revenue_per_customer"),
        round_half_up(F.col("_avg_recency"), 1).alias("avg_recency_days"),
        round_half_up(F.col("_avg_invoices"), 2).alias("avg_total_invoices"),
        round_half_up(pct(F.col("_revenue"), money_total("_revenue", total)), 2).alias("revenue_percent"),
    )
