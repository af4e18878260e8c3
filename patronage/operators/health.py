"""Health score, tiers, priorities and the customer-360 table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions.fixed_values import (
    HEALTH_ORDER, HEALTH_TIERS, LOWEST_HEALTH_TIER, LOWEST_VALUE_TIER, PRIORITY_ACTIONS, PRIORITY_ORDER,
    PRIORITY_STRATEGIES, UNSCORED_ACTION, VALUE_TIERS,
)
from patronage.functions.numeric import clip, exact_avg, money_sum, pct, ratio, round_half_up
from patronage.functions.rules import at_least, first_match, flag, label_map
from patronage.operators.ranking import QUINTILES, Histogram, attach_average_ranks, histogram, quantile_values

RISKY = ["High Risk", "Critical Risk"]
BEST_SEGMENTS = ["Champions", "Loyal Customers", "Big Spenders"]
PCT = "decimal(12,4)"
RANKED = ["total_revenue", "purchase_frequency_per_month"]


def health_score(revenue_share: Column, frequency_share: Column) -> Column:
    """0-100: 40 RFM, 30 churn safety (15 when unscored), 20 revenue rank, 10 engagement."""
    rfm = F.col("rfm_total_score") / F.lit(15.0) * F.lit(40.0)
    safety = F.when(F.col("model_scored") == 1, (F.lit(1.0) - F.col("churn_probability")) * F.lit(30.0)).otherwise(15.0)
    engagement = (F.col("is_repeat_buyer") * F.lit(0.5) + frequency_share * F.lit(0.5)) * F.lit(10.0)
    return clip(round_half_up(rfm + safety + revenue_share * F.lit(20.0) + engagement, 2), 0.0, 100.0)


def action_priority(top_revenue: Column) -> Column:
    """Five priorities; the order of the rules replaces the exclusions."""
    tier, risk, segment = F.col("health_tier"), F.col("churn_risk_tier"), F.col("rfm_segment")
    return first_match(
        [
            (tier.isin("Critical", "At Risk") | (risk == "Critical Risk"), "Priority 1"),
            (segment.isin("Cannot Lose", "At Risk") | (top_revenue & risk.isin(*RISKY)), "Priority 2"),
            (segment.isin("Potential Loyalists", "New Customers") | (tier == "Watchlist"), "Priority 3"),
            (segment.isin(*BEST_SEGMENTS) & tier.isin("Excellent", "Healthy"), "Priority 4"),
        ],
        "Priority 5",
    )


def customer_360(rfm: DataFrame, churn: DataFrame, hist: Histogram | None = None) -> DataFrame:
    """The 46-column customer table from RFM rows (one per customer) and churn predictions."""
    hist = hist or histogram(rfm, RANKED)
    top_cut = quantile_values(hist, QUINTILES)["total_revenue"]["q"][QUINTILES.index(0.8)]
    scored = churn.withColumnRenamed("risk_tier", "churn_risk_tier")
    joined = rfm.drop("active_purchase_span_days").join(scored, "customer_id", "left")
    joined = joined.withColumn("model_scored", flag(F.col("churn_probability").isNotNull())).withColumn(
        "churn_risk_tier", F.when(F.col("model_scored") == 0, "Not Scored").otherwise(F.col("churn_risk_tier"))
    )
    ranked = attach_average_ranks(joined, "customer_id", hist, {c: F.col(c) for c in RANKED})
    risk, segment = F.col("churn_risk_tier"), F.col("rfm_segment")
    return (
        ranked.withColumn("customer_health_score", health_score(F.col("total_revenue_rank"), F.col("purchase_frequency_per_month_rank")))
        .withColumn("health_tier", at_least("customer_health_score", HEALTH_TIERS, LOWEST_HEALTH_TIER))
        .withColumn("customer_value_tier", at_least("total_revenue_rank", VALUE_TIERS, LOWEST_VALUE_TIER))
        .withColumn("action_priority", action_priority(F.col("total_revenue") >= F.lit(float(top_cut))))
        .withColumn("final_recommended_action", label_map("action_priority", PRIORITY_ACTIONS, UNSCORED_ACTION))
        .withColumn(
            "retention_target_flag",
            flag(risk.isin(*RISKY) | F.col("health_tier").isin("At Risk", "Critical") | segment.isin("Cannot Lose", "At Risk")),
        )
        .withColumn(
            "vip_flag",
            flag(segment.isin(*BEST_SEGMENTS) & F.col("customer_value_tier").isin("Top 10% Value", "High Value")),
        )
        .drop(*[f"{c}_rank" for c in RANKED])
    )


def domain(df: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """A fixed list of labels with its order, as a small frame."""
    rows = F.array(*[F.struct(F.lit(v).alias(name), F.lit(i).alias("ord")) for i, v in enumerate(labels, 1)])
    return df.sparkSession.range(1).select(F.explode(rows).alias("d")).select("d.*")


def tier_counts(c360: DataFrame, dim: str = "health_tier", labels: list[str] = HEALTH_ORDER) -> DataFrame:
    """Customers and share per tier over the whole domain; absent tiers count zero."""
    counts = c360.groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
    full = domain(c360, dim, labels).join(counts, dim, "left").fillna({"n": 0})
    total = c360.agg(F.count(F.lit(1))).scalar()
    return full.select(
        dim, F.col("n").alias("customer_count"), round_half_up(pct(F.col("n"), total), 2).alias("customer_percent"), "ord"
    )


def tier_revenue(c360: DataFrame, labels: list[str] = HEALTH_ORDER) -> DataFrame:
    """Revenue, share and flags per health tier over the whole domain."""
    groups = c360.groupBy("health_tier").agg(
        money_sum("total_revenue").alias("_revenue"),
        F.count("customer_id").alias("_n"),
        exact_avg("churn_probability", PCT).alias("_prob"),
        F.sum("retention_target_flag").alias("retention_target_count"),
        F.sum("vip_flag").alias("vip_count"),
    )
    total = c360.agg(money_sum("total_revenue")).scalar()
    full = domain(c360, "health_tier", labels).join(groups, "health_tier", "left")
    return full.select(
        "health_tier",
        round_half_up(F.col("_revenue"), 2).alias("total_revenue"),
        round_half_up(pct(F.col("_revenue"), total), 2).alias("revenue_percent"),
        round_half_up(ratio(F.col("_revenue"), F.col("_n")), 2).alias("avg_revenue_per_customer"),
        round_half_up(F.col("_prob"), 4).alias("avg_churn_probability"),
        "retention_target_count",
        "vip_count",
        "ord",
    )


def action_plan(c360: DataFrame, labels: list[str] = PRIORITY_ORDER) -> DataFrame:
    """Customers, revenue, churn probability and strategy per priority over the whole domain."""
    groups = c360.groupBy("action_priority").agg(
        F.count("customer_id").alias("customer_count"),
        money_sum("total_revenue").alias("_revenue"),
        exact_avg("churn_probability", PCT).alias("_prob"),
        F.min_by("final_recommended_action", "customer_id").alias("first_action"),
    )
    full = domain(c360, "action_priority", labels).join(groups, "action_priority", "left")
    return full.select(
        "action_priority",
        "customer_count",
        round_half_up(F.col("_revenue"), 2).alias("total_revenue"),
        round_half_up(F.col("_prob"), 4).alias("avg_churn_probability"),
        label_map("action_priority", PRIORITY_STRATEGIES).alias("recommended_strategy"),
        "first_action",
        "ord",
    )
