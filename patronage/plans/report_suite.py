"""The named business reports, run together and written out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from patronage.operators import quality, reports, sales
from patronage.sources.writers import write_reports

CUSTOMER_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "executive_kpis": reports.executive_kpis,
    "health_tier_summary": reports.health_tier_summary,
    "rfm_segment_summary": reports.rfm_segment_summary,
    "churn_risk_summary": reports.churn_risk_summary,
    "country_revenue": reports.country_report,
    "top_customers": reports.top_customers,
    "action_priority_summary": reports.action_priority_summary,
    "customer_value_tiers": reports.value_tier_summary,
}
SALES_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "monthly_revenue": sales.monthly_report,
    "product_revenue": sales.product_report,
}
ROW_LIMITS = {"executive_kpis": (1, 1), "top_customers": (1, 50), "product_revenue": (1, 50)}


def build_reports(c360: DataFrame, clean: DataFrame) -> dict[str, DataFrame]:
    """All ten reports by name; the tables are also registered as views for ad-hoc SQL."""
    c360.createOrReplaceTempView("customer_360")
    clean.createOrReplaceTempView("clean_transactions")
    out = {name: build(c360) for name, build in CUSTOMER_REPORTS.items()}
    return out | {name: build(clean) for name, build in SALES_REPORTS.items()}


def run_reports(c360: DataFrame, clean: DataFrame, folder: str) -> DataFrame:
    """Write every report and return the shape checks."""
    built = build_reports(c360, clean)
    write_reports(built, folder)
    return quality.report_shapes(built, ROW_LIMITS)
