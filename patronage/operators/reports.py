"""Business reports over the customer-360 table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.fixed_values import HEALTH_ORDER, PRIORITY_ORDER, RISK_ORDER, VALUE_ORDER
from patronage.functions.numeric import exact_avg, money_sum, money_total, pct, ratio, round_half_up
from patronage.functions.rules import order_of
from patronage.operators.ranking import exact_quantiles

PCT = "decimal(12,4)"

# measure name -> aggregate before rounding, digits (None: a count, not rounded)
MEASURES = {
    "avg_revenue_per_customer": (lambda: exact_avg("total_revenue"), 2),
    "avg_recency_days": (lambda: exact_avg("recency_days"), 1),
    "avg_total_invoices": (lambda: exact_avg("total_invoices"), 2),
    "avg_health_score": (lambda: exact_avg("customer_health_score", PCT), 2),
    "avg_churn_probability": (lambda: exact_avg("churn_probability", PCT), 4),
    "retention_target_count": (lambda: F.sum("retention_target_flag"), None),
    "vip_count": (lambda: F.sum("vip_flag"), None),
}


def dimension_summary(
    c360: DataFrame, dim: str, measures: Sequence[str], customer_share: bool = True, name: str | None = None
) -> DataFrame:
    """Customers, revenue and measures per value of a dimension, with shares of the grand total.

    The shares use a window over the grouped rows: one row per tier, segment or country.
    """
    name = name or dim
    aggregates = [MEASURES[m][0]().alias(m) for m in measures]
    groups = c360.groupBy(F.col(dim).alias(name)).agg(
        F.count(F.lit(1)).alias("customer_count"), money_sum("total_revenue").alias("_revenue"), *aggregates
    )
    everything = Window.partitionBy()
    out = [F.col(name), F.col("customer_count")]
    if customer_share:
        share = pct(F.col("customer_count"), F.sum("customer_count").over(everything))
        out.append(round_half_up(share, 2).alias("customer_pct"))
    out += [
        round_half_up(F.col("_revenue"), 2).alias("total_revenue"),
        round_half_up(pct(F.col("_revenue"), money_total("_revenue", everything)), 2).alias("revenue_pct"),
    ]
    for m in measures:
        digits = MEASURES[m][1]
        out.append(F.col(m) if digits is None else round_half_up(F.col(m), digits).alias(m))
    return groups.select(*out)


FLAGS = ["retention_target_count", "vip_count"]


def health_tier_summary(c360: DataFrame) -> DataFrame:
    measures = ["avg_revenue_per_customer", "avg_health_score", "avg_churn_probability", *FLAGS]
    return dimension_summary(c360, "health_tier", measures).orderBy(order_of("health_tier", HEALTH_ORDER))


def rfm_segment_summary(c360: DataFrame) -> DataFrame:
    measures = ["avg_revenue_per_customer", "avg_recency_days", "avg_total_invoices", "avg_churn_probability", *FLAGS]
    return dimension_summary(c360, "rfm_segment", measures).orderBy(F.desc("total_revenue"), "rfm_segment")


def churn_risk_summary(c360: DataFrame) -> DataFrame:
    measures = ["avg_churn_probability", "avg_health_score", *FLAGS]
    return dimension_summary(c360, "churn_risk_tier", measures).orderBy(order_of("churn_risk_tier", RISK_ORDER))


def country_report(c360: DataFrame) -> DataFrame:
    measures = ["avg_revenue_per_customer", *FLAGS, "avg_churn_probability"]
    out = dimension_summary(c360, "country_mode", measures, customer_share=False, name="country")
    return out.orderBy(F.desc("total_revenue"), "country")


def action_priority_summary(c360: DataFrame) -> DataFrame:
    measures = ["avg_revenue_per_customer", "avg_churn_probability", *FLAGS]
    return dimension_summary(c360, "action_priority", measures).orderBy(order_of("action_priority", PRIORITY_ORDER))


def value_tier_summary(c360: DataFrame) -> DataFrame:
    measures = ["avg_revenue_per_customer", "avg_health_score", "avg_churn_probability", *FLAGS]
    return dimension_summary(c360, "customer_value_tier", measures).orderBy(order_of("customer_value_tier", VALUE_ORDER))


def executive_kpis(c360: DataFrame) -> DataFrame:
    """Fifteen headline figures in one row; the median is exact."""
    good = F.col("health_tier").isin("Excellent", "Healthy")
    risky = F.col("churn_risk_tier").isin("Critical Risk", "High Risk")

    def count_if(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    def revenue_if(condition: Column) -> Column:
        return F.coalesce(money_sum(F.when(condition, F.col("total_revenue"))), F.lit(0.0))

    median = exact_quantiles(c360, ["total_revenue"], [0.5]).select(F.col("q")[0]).scalar()
    return c360.agg(
        F.count(F.lit(1)).alias("total_customers"),
        round_half_up(money_sum("total_revenue"), 2).alias("total_revenue"),
        round_half_up(exact_avg("total_revenue"), 2).alias("avg_revenue_per_customer"),
        F.sum("total_invoices").alias("total_invoices"),
        round_half_up(exact_avg("total_invoices"), 2).alias("avg_invoices_per_customer"),
        F.sum("retention_target_flag").alias("retention_targets"),
        F.sum("vip_flag").alias("vip_customers"),
        count_if(F.col("model_scored") == 1).alias("model_scored_customers"),
        count_if(F.col("model_scored") == 0).alias("not_scored_customers"),
        count_if(good).alias("excellent_healthy_customers"),
        round_half_up(revenue_if(good), 2).alias("excellent_healthy_revenue"),
        round_half_up(pct(revenue_if(good), money_sum("total_revenue")), 2).alias("excellent_healthy_revenue_pct"),
        count_if(risky).alias("critical_high_risk_customers"),
        round_half_up(revenue_if(risky), 2).alias("critical_high_risk_revenue"),
    ).withColumn("median_revenue_per_customer", round_half_up(median, 2))


def top_customers(c360: DataFrame, k: int = 50) -> DataFrame:
    """Profile of the k customers with the most revenue."""
    profile = c360.select(
        "customer_id",
        F.col("country_mode").alias("country"),
        round_half_up(F.col("total_revenue"), 2).alias("total_revenue"),
        "total_invoices",
        "recency_days",
        "rfm_segment",
        "health_tier",
        round_half_up(F.col("customer_health_score"), 2).alias("customer_health_score"),
        round_half_up(F.col("churn_probability"), 4).alias("churn_probability"),
        "churn_risk_tier",
        "action_priority",
        "customer_value_tier",
        "retention_target_flag",
        "vip_flag",
    )
    return profile.orderBy(F.desc("total_revenue"), "customer_id").limit(k)


RISK_COLUMNS = [
    "customer_id", "country_mode", "total_revenue", "rfm_segment", "health_tier", "churn_probability",
    "churn_risk_tier", "action_priority", "final_recommended_action",
]


def top_risk_customers(c360: DataFrame, k: int = 20) -> DataFrame:
    """The k scored customers most likely to churn."""
    scored = c360.where(F.col("model_scored") == 1).select(*RISK_COLUMNS)
    return scored.orderBy(F.desc("churn_probability"), "customer_id").limit(k)


def filter_customers(
    c360: DataFrame,
    health: Sequence[str] = (),
    segments: Sequence[str] = (),
    risk: Sequence[str] = (),
    priorities: Sequence[str] = (),
    values: Sequence[str] = (),
    countries: Sequence[str] = (),
    scored: bool | None = None,
    revenue: tuple[float, float] | None = None,
    probability: tuple[float, float] | None = None,
) -> DataFrame:
    """Conjunction of the given filters; the probability range spares unscored customers."""
    lists = {
        "health_tier": health, "rfm_segment": segments, "churn_risk_tier": risk,
        "action_priority": priorities, "customer_value_tier": values, "country_mode": countries,
    }
    for column, allowed in lists.items():
        if allowed:
            c360 = c360.where(F.col(column).isin(*allowed))
    if scored is not None:
        c360 = c360.where(F.col("model_scored") == int(scored))
    if revenue is not None:
        c360 = c360.where(F.col("total_revenue").between(*revenue))
    if probability is not None:
        c360 = c360.where((F.col("model_scored") == 0) | F.col("churn_probability").between(*probability))
    return c360


def score_profile(c360: DataFrame) -> DataFrame:
    """Five 0-5 scores per customer: recency, frequency, monetary, health and churn safety."""
    safety = F.when(F.col("model_scored") == 1, (F.lit(1.0) - F.col("churn_probability")) * F.lit(5.0)).otherwise(2.5)
    return c360.select(
        "customer_id",
        F.col("r_score").cast("double").alias("recency"),
        F.col("f_score").cast("double").alias("frequency"),
        F.col("m_score").cast("double").alias("monetary"),
        (F.col("customer_health_score") / F.lit(20.0)).alias("health"),
        safety.alias("churn_safety"),
    )


def customer_lookup(c360: DataFrame, customer_id: int) -> DataFrame:
    return c360.where(F.col("customer_id") == customer_id)


def group_sizes(df: DataFrame, *keys: str, out: str = "customers") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def value_counts(df: DataFrame, column: str, out: str = "customer_count") -> DataFrame:
    """Counts and shares of a category column."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(out))
    return counts.withColumn("percentage", pct(F.col(out), F.sum(out).over(Window.partitionBy())))


def flagged_revenue(c360: DataFrame, flag: str, dim: str) -> DataFrame:
    """Revenue of the flagged customers per value of a dimension."""
    return c360.where(F.col(flag) == 1).groupBy(dim).agg(round_half_up(money_sum("total_revenue"), 2).alias("total_revenue"))


def high_risk_export(c360: DataFrame) -> DataFrame:
    return c360.where(F.col("churn_risk_tier").isin("High Risk", "Critical Risk"))


def vip_export(c360: DataFrame) -> DataFrame:
    return c360.where(F.col("vip_flag") == 1)


def action_export(c360: DataFrame) -> DataFrame:
    return c360.groupBy("action_priority").agg(
        F.count("customer_id").alias("customer_count"),
        money_sum("total_revenue").alias("total_revenue"),
        exact_avg("churn_probability", PCT).alias("avg_churn_probability"),
    )


def top_group(c360: DataFrame, dim: str) -> DataFrame:
    """The group with the most revenue and that revenue."""
    groups = c360.groupBy(dim).agg(money_sum("total_revenue").alias("total_revenue"))
    return groups.orderBy(F.desc("total_revenue"), dim).limit(1)


def mean_by(c360: DataFrame, dim: str, measure: str) -> DataFrame:
    return c360.groupBy(dim).agg(ratio(money_sum(measure), F.count(measure)).alias(f"avg_{measure}"))
