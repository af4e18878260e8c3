"""The customer chain: lines -> features -> segments -> labels -> customer 360."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patronage.operators import churn, features, health, rfm
from patronage.operators.ranking import histogram
from patronage.plans.stages import stage
from patronage.sources import tables

CUTOFF = "2001-01-01"
SCORED = ["recency_days", "total_invoices", "total_revenue", "purchase_frequency_per_month"]

def sales_lines(spark: SparkSession, folder: str) -> DataFrame:
    return tables.sales(spark, folder, features.SALES_COLUMNS)


def build_base(spark: SparkSession, folder: str, cutoff: str = CUTOFF) -> DataFrame:
    """Full-period and observation measures of every customer, from one pass over the lines."""
    window = churn.observation_window(cutoff)
    return stage(
        spark, folder, f"customer_base {cutoff}", lambda: features.customer_base(sales_lines(spark, folder), window)
    )


def build_features(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        returned = tables.returns(spark, folder, features.RETURN_COLUMNS)
        return features.customer_features(build_base(spark, folder), returned)

    return stage(spark, folder, "customer_features", build)


def build_labels(spark: SparkSession, folder: str, cutoff: str = CUTOFF) -> DataFrame:
    """Labels straight from the customer rows: a customer-sized read, not stored again."""
    spans = build_base(spark, folder, cutoff).withColumnRenamed("first_purchase_date", "first_line_date")
    return churn.churn_labels(spans, cutoff)


def build_churn_base(spark: SparkSession, folder: str, cutoff: str = CUTOFF) -> DataFrame:
    def build() -> DataFrame:
        scored = churn.observation_scores(churn.observation_base(build_base(spark, folder, cutoff), cutoff))
        return churn.churn_model_base(build_labels(spark, folder, cutoff), scored)

    return stage(spark, folder, f"churn_base {cutoff}", build)


def build_rfm(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "rfm_segments", lambda: rfm.rfm_segments(build_features(spark, folder)))


def build_customer_360(spark: SparkSession, folder: str, predictions: DataFrame | None = None) -> DataFrame:
    """Customer 360 with the given predictions, else with the inactivity score (no model needed)."""

    def build(scored: DataFrame) -> DataFrame:
        table = build_features(spark, folder)
        hist = histogram(table, SCORED)
        return health.customer_360(rfm.rfm_segments(table, hist), scored, hist)

    if predictions is not None:
        return build(predictions)
    scored = churn.recency_score(build_churn_base(spark, folder))
    return stage(spark, folder, "customer_360", lambda: build(scored))
