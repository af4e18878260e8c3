"""Time-window churn labels, observation-only features and churn rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.fixed_values import (
    CHURN_BASE_COLUMNS, FREQUENCY_EDGES, FREQUENCY_LABELS, LEAKAGE_COLUMNS, MONETARY_LABELS, NO_SEGMENT,
    RECENCY_EDGES, RECENCY_LABELS, RISK_TIERS, TOP_RISK_TIER,
)
from patronage.functions.numeric import clip, elapsed_days, pct, round_half_up
from patronage.functions.rules import flag, label_map, right_closed_bins, under
from patronage.operators.features import ratio_features
from patronage.operators.ranking import (
    QUINTILES, equal_width_score, global_position, histogram, quantile_bin, quantile_cut_is_usable, quantile_values,
)


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def observation(sales: DataFrame, cutoff: str) -> DataFrame:
    return sales.where(F.col("invoice_date") < moment(cutoff))


def prediction(sales: DataFrame, cutoff: str) -> DataFrame:
    return sales.where(F.col("invoice_date") >= moment(cutoff))


def purchase_spans(sales: DataFrame) -> DataFrame:
    """First and last line of every customer."""
    return sales.groupBy("customer_id").agg(
        F.min("invoice_date").alias("first_line_date"), F.max("invoice_date").alias("last_line_date")
    )


def churn_labels(spans: DataFrame, cutoff: str) -> DataFrame:
    """Customers seen before the cutoff, labelled by whether they come back.

    A customer bought before the cutoff when the first line is earlier, and after it when the last
    line is not: the labels need neither the lines nor a join. ``spans`` should be stored, as the
    ends of the data are read from it too.
    """
    first, last, cut = F.col("first_line_date"), F.col("last_line_date"), moment(cutoff)
    start = spans.agg(F.min(first)).scalar()
    end = spans.agg(F.max(last)).scalar()
    returned = flag(last >= cut)
    return spans.where(first < cut).select(
        "customer_id",
        F.to_date(start).alias("observation_start_date"),
        F.date_sub(F.to_date(cut), 1).alias("observation_end_date"),
        F.to_date(cut).alias("prediction_start_date"),
        F.to_date(end).alias("prediction_end_date"),
        F.lit(1).alias("purchased_in_observation"),
        returned.alias("purchased_in_prediction"),
        (1 - returned).alias("churned"),
    )


def label_distribution(labels: DataFrame) -> DataFrame:
    counts = labels.groupBy("churned").agg(F.count(F.lit(1)).alias("customer_count"))
    share = pct(F.col("customer_count"), F.sum("customer_count").over(Window.partitionBy()))  # two rows
    return counts.withColumn("customer_percent", round_half_up(share, 2))


def class_balance(labels: DataFrame, low: float = 20.0, high: float = 80.0) -> DataFrame:
    """Churn rate with a verdict on class balance."""
    rate = pct(F.sum("churned"), F.count(F.lit(1)))
    return labels.agg(rate.alias("churn_rate")).withColumn("balanced", F.col("churn_rate").between(low, high))


def observation_window(cutoff: str) -> dict[str, Column]:
    """The lines before the cutoff as a window of ``customer_base``."""
    return {"obs_": F.col("invoice_date") < moment(cutoff)}


def observation_base(base: DataFrame, cutoff: str) -> DataFrame:
    """Unscored observation features of the customers seen before the cutoff; recency is counted from it.

    ``base`` is ``customer_base`` with the observation window.
    """
    seen = base.where(F.col("obs_total_invoices") > 0).select(
        "customer_id", *[c for c in base.columns if c.startswith("obs_")]
    )
    first, last = F.col("obs_first_purchase_date"), F.col("obs_last_purchase_date")
    return seen.withColumns(
        {"obs_tenure_days": elapsed_days(first, last), "obs_recency_days": elapsed_days(last, moment(cutoff))}
    ).withColumns(ratio_features("obs_", "obs_tenure_days"))


OBS_SCORES = {
    "obs_r_score": ("obs_recency_days", False),
    "obs_f_score": ("obs_total_invoices", True),
    "obs_m_score": ("obs_total_revenue", True),
}


def observation_scores(base: DataFrame) -> DataFrame:
    """Rank-based r, f, m scores; the three columns are ranked in one range-partitioned pass."""
    entries = F.array(
        *[
            F.struct(F.lit(out).alias("score"), F.col(c).cast("double").alias("value"))
            for out, (c, _) in OBS_SCORES.items()
        ]
    )
    long = base.select("customer_id", F.explode(entries).alias("e")).select("customer_id", "e.score", "e.value")
    ranked = global_position(long, ["value", "customer_id"], "_pos", ["score"])
    wide = ranked.groupBy("customer_id").agg(
        *[
            F.max(
                F.when(
                    F.col("score") == out,
                    equal_width_score(F.col("_pos"), F.col("all_rows"), higher_is_better=higher),
                )
            ).alias(out)
            for out, (_, higher) in OBS_SCORES.items()
        ]
    )
    total = sum((F.col(c) for c in OBS_SCORES), F.lit(0)).cast("int")
    return base.join(wide, "customer_id").withColumn("obs_rfm_total_score", total)


def churn_model_base(labels: DataFrame, scored: DataFrame) -> DataFrame:
    """Labels beside observation features, in model column order."""
    label_columns = labels.select("customer_id", "churned", "purchased_in_prediction")
    return label_columns.join(scored, "customer_id", "left").select(*CHURN_BASE_COLUMNS)


def leakage_check(base: DataFrame, cutoff: str) -> DataFrame:
    """Forbidden or unprefixed columns and any feature date at or after the cutoff: (check, violations)."""
    free = {"customer_id", "churned", "purchased_in_prediction"}
    forbidden = len([c for c in base.columns if c in LEAKAGE_COLUMNS])
    unprefixed = len([c for c in base.columns if c not in free and not c.startswith("obs_")])
    late = F.count(F.when(F.col("obs_last_purchase_date") >= moment(cutoff), 1))
    checks = [
        ("forbidden_columns", F.lit(forbidden).cast("long")),
        ("unprefixed_columns", F.lit(unprefixed).cast("long")),
        ("dates_after_cutoff", F.col("_late")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), v.alias("violations")) for n, v in checks])
    found = base.agg(late.alias("_late")).select(F.explode(rows).alias("c")).select("c.*")
    return found.withColumn("passed", F.col("violations") == 0)


def recency_bucket(c: Column) -> Column:
    return right_closed_bins(c, RECENCY_EDGES, RECENCY_LABELS)


def frequency_bucket(c: Column) -> Column:
    return right_closed_bins(c, FREQUENCY_EDGES, FREQUENCY_LABELS)


def with_monetary_bucket(base: DataFrame, column: str, out: str) -> DataFrame:
    """Five revenue buckets at the quantiles, by rank where the quantiles are too few."""
    hist = histogram(base, [column])
    edges = quantile_values(hist, QUINTILES)
    labels = dict(enumerate(MONETARY_LABELS, 1))
    if quantile_cut_is_usable(hist, edges)[column]:
        return base.withColumn(out, label_map(quantile_bin(F.col(column).cast("double"), edges[column]["q"]), labels))
    ranked = global_position(base.select("customer_id", column), [column, "customer_id"], "_pos")
    scores = ranked.select("customer_id", equal_width_score(F.col("_pos"), F.col("all_rows")).alias("_bin"))
    return base.join(scores, "customer_id", "left").withColumn(out, label_map("_bin", labels)).drop("_bin")


def churn_by(df: DataFrame, bucket: str) -> DataFrame:
    """Customers, churned customers and churn rate per bucket; rows without a bucket are left out."""
    return (
        df.where(F.col(bucket).isNotNull())
        .groupBy(bucket)
        .agg(F.count("customer_id").alias("customers"), F.sum("churned").alias("churned_customers"))
        .withColumn("churn_rate", round_half_up(pct(F.col("churned_customers"), F.col("customers")), 2))
    )


def churn_by_segment(labels: DataFrame, segments: DataFrame) -> DataFrame:
    """Churn and retention rate per segment; customers without a segment form their own group."""
    joined = labels.select("customer_id", "churned").join(
        segments.select("customer_id", "rfm_segment"), "customer_id", "left"
    )
    rates = churn_by(joined.fillna({"rfm_segment": NO_SEGMENT}), "rfm_segment")
    kept = F.col("customers") - F.col("churned_customers")
    return rates.withColumn("retained_customers", kept).withColumn(
        "retention_rate", round_half_up(pct(kept, F.col("customers")), 2)
    )


def risk_tier(probability: str | Column) -> Column:
    """Risk tier of the unrounded probability."""
    return under(probability, RISK_TIERS, TOP_RISK_TIER)


def predictions(scored: DataFrame, probability: Column, threshold: float = 0.5) -> DataFrame:
    """The five prediction columns from a table with customer_id, churned and a probability."""
    return scored.select(
        "customer_id",
        F.col("churned").alias("actual_churned"),
        flag(probability >= threshold).alias("predicted_churned"),
        round_half_up(probability, 4).alias("churn_probability"),
        risk_tier(probability).alias("risk_tier"),
    )


def recency_score(base: DataFrame, horizon_days: float = 730.0) -> DataFrame:
    """A churn score without a model: observed inactivity as a share of the horizon."""
    score = clip(F.col("obs_recency_days") / F.lit(horizon_days), 0.0, 1.0)
    return predictions(base, score)


def key_sets(spans: DataFrame, cutoff: str) -> DataFrame:
    """Sizes of the customer sets around the cutoff, by set operations on the keys of stored spans."""
    before = spans.where(F.col("first_line_date") < moment(cutoff)).select("customer_id")
    after = spans.where(F.col("last_line_date") >= moment(cutoff)).select("customer_id")
    sets = {
        "observation": before,
        "prediction": after,
        "churned": before.join(after, "customer_id", "left_anti"),
        "retained": before.join(after, "customer_id", "left_semi"),
        "prediction_only": after.subtract(before),
        "both": before.intersect(after),
        "any": before.union(after).distinct(),
    }
    out = None
    for name, keys in sets.items():
        row = keys.agg(F.count(F.lit(1)).alias("customers")).select(F.lit(name).alias("key_set"), "customers")
        out = row if out is None else out.unionByName(row)
    return out
