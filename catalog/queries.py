"""name -> (spark, folder) -> DataFrame, one entry per operator or tight group of operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.functions.numeric import round_half_up
from patronage.operators import (
    churn, cleaning, complaints as cx, contingency, features, health, modelling, quality, ranking, reports, rfm, sales,
    statistics, tfidf, topics, vectors, word_factors,
)
from patronage.plans import complaint_text, customer360 as chain, report_suite
from patronage.plans.stages import stage
from patronage.session import ensure_checkpoint_dir, pin
from patronage.sources import envelopes, readers, tables, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Words of the test corpus that stand for the sentiment lexicon and the stop words (parameters of the operators).
POSITIVE = ["the", "of", "is"]
NEGATIVE = ["and", "to", "in"]
STOP_WORDS = [
    "the", "and", "of", "to", "in", "is", "that", "it", "for", "on", "with", "by", "as", "are", "was",
    "la", "le", "de", "et", "les", "der", "die", "und", "el", "en",
]
TFIDF_OPTIONS = {"stop_words": STOP_WORDS, "min_df": 10, "max_df": 0.90, "max_features": 5000}
NEGATIVE_OPTIONS = {"stop_words": STOP_WORDS}
HABITS = ["total_invoices", "total_revenue", "unique_products", "return_rate"]
CHANNEL_ROWS = 25
LOOKED_UP = 7
CONTRIBUTION_WEIGHTS = {"obs_recency_days": 0.004, "obs_total_invoices": -0.11, "obs_unique_products": -0.02}


def tidy(df: DataFrame) -> DataFrame:
    """Plain result types: whole numbers as long, decimals as double, times as text."""
    plain = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        plain.append(c.alias(name))
    return df.select(*plain)


def query(name: str | None = None):
    def register(build):
        QUERIES[name or build.__name__] = lambda spark, folder: tidy(build(spark, folder))
        return build

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in columns})


def lines(spark, folder, *columns):
    return tables.sales(spark, folder, columns)


# ---- sales reports ------------------------------------------------------------------------------


@query()
def monthly_revenue(spark, folder):
    return sales.revenue_by(lines(spark, folder, "invoice_yearmonth", "revenue"), "invoice_yearmonth")


@query()
def monthly_customers(spark, folder):
    months = lines(spark, folder, "invoice_yearmonth", "customer_id")
    return sales.distinct_by(months, "invoice_yearmonth", "customer_id", "unique_customers")


@query()
def dataset_overview(spark, folder):
    return sales.dataset_overview(
        lines(spark, folder, "customer_id", "invoice_id", "stock_code", "country", "invoice_date"), lines(spark, folder, "stock_code")
    )


@query()
def revenue_metrics(spark, folder):
    return sales.revenue_metrics(lines(spark, folder, "invoice_id", "revenue", "quantity"))


@query()
def order_value_trend(spark, folder):
    out = sales.order_value_trend(lines(spark, folder, "invoice_yearmonth", "invoice_id", "revenue"))
    return rounded(out, 4, "avg_order_value")


@query()
def country_revenue_top10(spark, folder):
    found = sales.revenue_by_name(lines(spark, folder, "supplier_id", "revenue"), "supplier_id", tables.places(spark, folder), "country")
    return sales.top_by(found, "total_revenue", 10, "country")


@query()
def product_revenue_top10(spark, folder):
    found = sales.revenue_by(lines(spark, folder, "stock_code", "revenue"), "stock_code")
    return sales.top_by(found, "total_revenue", 10, "stock_code").join(tables.products(spark, folder), "stock_code")


@query()
def product_name_top10(spark, folder):
    found = sales.revenue_by_name(lines(spark, folder, "stock_code", "revenue"), "stock_code", tables.products(spark, folder), "description")
    return sales.top_by(found, "total_revenue", 10, "description")


@query()
def customer_revenue_top10(spark, folder):
    found = sales.revenue_by(lines(spark, folder, "customer_id", "revenue"), "customer_id")
    return sales.top_by(found, "total_revenue", 10, "customer_id")


@query()
def purchase_frequency(spark, folder):
    return sales.orders_per_customer(lines(spark, folder, "customer_id", "invoice_id"))


@query()
def order_distribution(spark, folder):
    return sales.distribution_summary(purchase_frequency(spark, folder), "num_orders").drop("metric")


@query()
def revenue_distribution(spark, folder):
    per_customer = sales.revenue_by(lines(spark, folder, "customer_id", "revenue"), "customer_id")
    return rounded(sales.distribution_summary(per_customer, "total_revenue").drop("metric"), 4, "median", "mean")


SUMMARISED = ["total_revenue", "total_invoices", "recency_days", "customer_tenure_days"]


@query()
def feature_summary(spark, folder):
    return rounded(sales.distribution_summary(chain.build_features(spark, folder), *SUMMARISED), 4, "median", "mean")


@query()
def top_feature_customers(spark, folder):
    found = chain.build_features(spark, folder).select("customer_id", "total_revenue", "total_invoices", "recency_days")
    return sales.top_by(found, "total_revenue", 10, "customer_id")


@query()
def repeat_behaviour(spark, folder):
    return sales.repeat_behaviour(lines(spark, folder, "customer_id", "invoice_id", "revenue"))


@query()
def repeat_revenue(spark, folder):
    sold = lines(spark, folder, "customer_id", "invoice_id", "revenue")
    repeat = sales.orders_per_customer(sold).where(F.col("num_orders") > 1)
    return sales.revenue_of_group(sold, repeat)


@query()
def frequency_histogram(spark, folder):
    return ranking.capped_histogram(purchase_frequency(spark, folder), "num_orders", 50, whole_cap=True)


@query()
def revenue_histogram(spark, folder):
    per_customer = sales.revenue_by(lines(spark, folder, "customer_id", "revenue"), "customer_id")
    return ranking.capped_histogram(per_customer, "total_revenue", 60)


@query()
def segment_recency_histogram(spark, folder):
    return ranking.capped_histogram(chain.build_rfm(spark, folder), "recency_days", 60, cap_prob=1.0, by="rfm_segment")


@query()
def segment_frequency_histogram(spark, folder):
    table = chain.build_rfm(spark, folder)
    return ranking.capped_histogram(table, "total_invoices", 50, whole_cap=True, by="rfm_segment")


@query()
def segment_monetary_histogram(spark, folder):
    return ranking.capped_histogram(chain.build_rfm(spark, folder), "total_revenue", 60, by="rfm_segment")


@query()
def churn_probability_histogram(spark, folder):
    return ranking.capped_histogram(c360(spark, folder).where("model_scored = 1"), "churn_probability", 40, cap_prob=1.0)


@query()
def peak_month(spark, folder):
    return sales.peak_and_low(monthly_revenue(spark, folder), "invoice_yearmonth", "total_revenue")


# ---- audit and cleaning -------------------------------------------------------------------------


def raw(spark, folder):
    return tables.raw_transactions(spark, folder)


@query()
def dq_audit(spark, folder):
    return quality.raw_audit(raw(spark, folder))


@query()
def clean_transactions(spark, folder):
    return cleaning.clean_transactions(raw(spark, folder))


@query()
def returns_split(spark, folder):
    return cleaning.returned_lines(raw(spark, folder))


@query()
def cleaning_steps(spark, folder):
    return cleaning.cleaning_steps(raw(spark, folder))


@query()
def clean_rules(spark, folder):
    return quality.clean_rules(cleaning.clean_transactions(raw(spark, folder)))


@query()
def stored_clean_rules(spark, folder):
    """The same rules over the cleaned lines as they are stored, and their number."""
    stored, found = quality.store_clean(cleaning.clean_transactions(raw(spark, folder)))
    return found.withColumn("rows", stored.agg(F.sum("_n")).scalar())


@query()
def envelope_ranges(spark, folder):
    """Events written as search replies and read back, each reply by several tasks."""
    events = tables.table(spark, folder, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("user_id").cast("string").alias("user_id"))
    numbered = pin(events.select(F.to_json(F.struct("*")).alias("record"), F.monotonically_increasing_id().alias("n")).withColumn("reply", F.shiftright("n", 33)))
    ends = numbered.groupBy("reply").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    text = F.concat(F.when(F.col("n") == F.col("first"), '{"took": 1, "hits": [').otherwise(""), "record", F.when(F.col("n") == F.col("last"), "]}").otherwise(","))
    path = sink(spark, "replies")
    numbered.join(ends, "reply").repartition("reply").sortWithinPartitions("reply", "n").select("reply", text.alias("value")).write.partitionBy("reply").text(path)
    files = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()]  # one a reply
    read = envelopes.read_large_hits(spark, files, "event_id string, event_type string, user_id string", 1 << 18)
    return read.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.max("event_id").alias("last_id"))


@query()
def null_profile(spark, folder):
    return quality.null_profile(cleaning.standardize(raw(spark, folder)))


@query()
def table_profile(spark, folder):
    return quality.table_profile(cleaning.standardize(raw(spark, folder)), "invoice_date").drop("data_type")


@query()
def key_metrics(spark, folder):
    found = quality.key_metrics(cleaning.clean_transactions(raw(spark, folder)))
    return rounded(found, 2, "total_revenue", "avg_order_value")


@query()
def domain_values(spark, folder):
    columns = ["health_tier", "rfm_segment", "churn_risk_tier", "action_priority", "customer_value_tier", "country_mode"]
    return quality.domain_values(c360(spark, folder), columns)


@query()
def dedup_key(spark, folder):
    docs = tables.table(spark, folder, "documents")
    keyed = docs.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_key"))
    return cleaning.dedup_keep_first(keyed, ["text_key"], ["doc_id"]).drop("text_key")


@query()
def reconcile_revenue(spark, folder):
    return quality.reconcile(c360(spark, folder), "total_revenue", lines(spark, folder, "revenue"), "revenue", 1.0)


@query()
def join_contract(spark, folder):
    return quality.join_keeps_rows(chain.build_features(spark, folder), c360(spark, folder), "customer_id")


@query()
def feature_rules(spark, folder):
    return quality.feature_rules(chain.build_features(spark, folder))


@query()
def rfm_rules(spark, folder):
    return quality.rfm_rules(chain.build_rfm(spark, folder))


# ---- features -----------------------------------------------------------------------------------


@query()
def invoice_rollup(spark, folder):
    return features.invoice_rollup(lines(spark, folder, "customer_id", "invoice_id", "invoice_date", "revenue", "quantity"))


@query()
def date_features(spark, folder):
    sold = lines(spark, folder, "customer_id", "invoice_id", "invoice_date", "revenue", "quantity")
    return features.date_features(features.invoice_rollup(sold), features.snapshot_after(sold))


@query()
def frequency_features(spark, folder):
    return features.frequency_features(
        lines(spark, folder, "customer_id", "invoice_id", "stock_code", "quantity", "invoice_date")
    )


@query()
def revenue_features(spark, folder):
    sold = lines(spark, folder, "customer_id", "invoice_id", "invoice_date", "revenue", "quantity")
    return features.revenue_features(features.invoice_rollup(sold))


@query()
def country_mode(spark, folder):
    return features.most_frequent(lines(spark, folder, "customer_id", "country"), "customer_id", "country", "country_mode")


@query()
def purchase_gap(spark, folder):
    return features.purchase_gap(lines(spark, folder, "customer_id", "invoice_date"))


@query()
def purchase_gap_lag(spark, folder):
    return features.purchase_gaps(lines(spark, folder, "customer_id", "invoice_date"))


@query()
def return_features(spark, folder):
    back = tables.returns(spark, folder, features.RETURN_COLUMNS)
    return features.return_features(back, lines(spark, folder, "customer_id").distinct())


@query()
def customer_features(spark, folder):
    return chain.build_features(spark, folder)


# ---- scores and segments ------------------------------------------------------------------------


@query()
def rank_quintile(spark, folder):
    table = chain.build_features(spark, folder).select("customer_id", "total_invoices", "recency_days")
    up = ranking.rank_quintile(table, "customer_id", "total_invoices", "frequency_score")
    return ranking.rank_quintile(up, "customer_id", "recency_days", "recency_score", higher_is_better=False)


@query()
def quantile_quintile(spark, folder):
    table = chain.build_features(spark, folder).select("customer_id", "recency_days", "total_invoices", "total_revenue")
    return ranking.quantile_scores(table, "customer_id", rfm.RFM_INPUTS)


@query()
def avg_rank_pct(spark, folder):
    table = chain.build_features(spark, folder).select("customer_id", "total_invoices", "purchase_frequency_per_month")
    return ranking.attach_average_ranks(
        table, "customer_id", ranking.histogram(table, ["total_invoices", "purchase_frequency_per_month"])
    )


@query()
def exact_quantiles(spark, folder):
    table = chain.build_features(spark, folder)
    found = ranking.quantiles(ranking.histogram(table, ["recency_days", "total_revenue"]), [0.5, 0.8, 0.95])
    return found.select(
        "metric", "n", "min", "max",
        *[round_half_up(F.col("q")[i], 6).alias(name) for i, name in enumerate(["median", "p80", "p95"])],
    )


@query()
def rfm_segments(spark, folder):
    return chain.build_rfm(spark, folder).select(
        "customer_id", "r_score", "f_score", "m_score", "rfm_score", "rfm_total_score", "rfm_average_score",
        "rfm_segment", "recommended_action",
    )


@query()
def rfm_segment_overview(spark, folder):
    return rfm.segment_summary(chain.build_rfm(spark, folder))


# ---- churn labels -------------------------------------------------------------------------------


@query()
def churn_labels(spark, folder):
    spans = pin(churn.purchase_spans(lines(spark, folder, "customer_id", "invoice_date")))
    return churn.churn_labels(spans, chain.CUTOFF)


@query()
def churn_model_base(spark, folder):
    return chain.build_churn_base(spark, folder)


@query()
def churn_by_recency(spark, folder):
    base = chain.build_churn_base(spark, folder)
    return churn.churn_by(base.withColumn("bucket", churn.recency_bucket(F.col("obs_recency_days"))), "bucket")


@query()
def churn_by_frequency(spark, folder):
    base = chain.build_churn_base(spark, folder)
    return churn.churn_by(base.withColumn("bucket", churn.frequency_bucket(F.col("obs_total_invoices"))), "bucket")


@query()
def churn_by_monetary(spark, folder):
    base = chain.build_churn_base(spark, folder)
    return churn.churn_by(churn.with_monetary_bucket(base, "obs_total_revenue", "bucket"), "bucket")


@query()
def churn_by_segment(spark, folder):
    return churn.churn_by_segment(chain.build_labels(spark, folder), chain.build_rfm(spark, folder))


@query()
def churn_label_distribution(spark, folder):
    return churn.label_distribution(chain.build_labels(spark, folder))


@query()
def class_balance(spark, folder):
    return rounded(churn.class_balance(chain.build_labels(spark, folder)), 6, "churn_rate")


@query()
def key_set_ops(spark, folder):
    spans = pin(churn.purchase_spans(lines(spark, folder, "customer_id", "invoice_date")))
    return churn.key_sets(spans, chain.CUTOFF)


@query()
def leakage_guard(spark, folder):
    return churn.leakage_check(chain.build_churn_base(spark, folder), chain.CUTOFF)


@query()
def churn_scores(spark, folder):
    return churn.recency_score(chain.build_churn_base(spark, folder))


# ---- customer 360 and its reports ---------------------------------------------------------------


def c360(spark, folder):
    return chain.build_customer_360(spark, folder)


QUERIES["customer_360"] = lambda spark, folder: tidy(c360(spark, folder))


@query()
def health_tier_counts(spark, folder):
    return health.tier_counts(c360(spark, folder))


@query()
def health_tier_revenue(spark, folder):
    return health.tier_revenue(c360(spark, folder))


@query()
def action_plan(spark, folder):
    return health.action_plan(c360(spark, folder))


for _name, _build in report_suite.CUSTOMER_REPORTS.items():
    QUERIES[_name] = lambda spark, folder, _build=_build: tidy(_build(c360(spark, folder)))


@query()
def monthly_report(spark, folder):
    return sales.monthly_report(lines(spark, folder, "invoice_yearmonth", "revenue", "invoice_id", "customer_id", "quantity"))


@query()
def product_report(spark, folder):
    measures = ["stock_code", "revenue", "quantity", "unit_price"]
    with_customers = lines(spark, folder, *measures, "invoice_id", "customer_id")
    return sales.product_report(with_customers, names=tables.products(spark, folder), sold=lines(spark, folder, *measures))


@query()
def report_shapes(spark, folder):
    sold = tables.sales(
        spark, folder,
        ["invoice_yearmonth", "stock_code", "description", "revenue", "quantity", "invoice_id", "customer_id", "unit_price"],
    )
    return quality.report_shapes(report_suite.build_reports(c360(spark, folder), sold), report_suite.ROW_LIMITS)


@query()
def filtered_customers(spark, folder):
    found = reports.filter_customers(
        c360(spark, folder), health=["Excellent", "Healthy", "Watchlist"], risk=["Low Risk", "Medium Risk", "Not Scored"],
        revenue=(500_000.0, 3_000_000.0), probability=(0.05, 0.5),
    )
    return found.select("customer_id", "health_tier", "churn_risk_tier", "total_revenue", "churn_probability")


@query()
def customer_profiles(spark, folder):
    return rounded(reports.score_profile(c360(spark, folder)), 6, "health", "churn_safety")


@query()
def segment_health_matrix(spark, folder):
    return reports.group_sizes(c360(spark, folder), "rfm_segment", "health_tier")


@query()
def value_tier_counts(spark, folder):
    return rounded(reports.value_counts(c360(spark, folder), "customer_value_tier"), 6, "percentage")


@query()
def vip_revenue(spark, folder):
    return reports.flagged_revenue(c360(spark, folder), "vip_flag", "rfm_segment")


@query()
def retention_revenue(spark, folder):
    return reports.flagged_revenue(c360(spark, folder), "retention_target_flag", "health_tier")


@query()
def top_segment(spark, folder):
    return reports.top_group(c360(spark, folder), "rfm_segment")


@query()
def top_risk_customers(spark, folder):
    return reports.top_risk_customers(c360(spark, folder))


@query()
def segment_mean_revenue(spark, folder):
    return rounded(reports.mean_by(c360(spark, folder), "rfm_segment", "total_revenue"), 4, "avg_total_revenue")


@query()
def high_risk_export(spark, folder):
    return reports.high_risk_export(c360(spark, folder)).select("customer_id", "churn_risk_tier", "churn_probability", "total_revenue")


@query()
def vip_export(spark, folder):
    return reports.vip_export(c360(spark, folder)).select("customer_id", "rfm_segment", "customer_value_tier", "total_revenue")


@query()
def action_export(spark, folder):
    return rounded(reports.action_export(c360(spark, folder)), 6, "avg_churn_probability")


# ---- complaint text -----------------------------------------------------------------------------


def complaints(spark, folder):
    return tables.complaints(spark, folder)


def cleaned(spark, folder):
    return complaint_text.build_cleaned(spark, folder)


def scored_complaints(spark, folder):
    return complaint_text.build_sentiment(spark, folder, POSITIVE, NEGATIVE)


@query()
def text_clean(spark, folder):
    return cleaned(spark, folder).select("complaint_id", "clean_text")


@query()
def text_clean_redacted(spark, folder):
    return complaint_text.build_redacted(spark, folder)


@query()
def token_lists(spark, folder):
    found = complaint_text.build_sentences(spark, folder)
    return found.select("complaint_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query()
def text_measures(spark, folder):
    measured = cx.text_measures(cleaned(spark, folder))
    return measured.select("complaint_id", "text_length", "word_count")


@query()
def text_statistics(spark, folder):
    return rounded(cx.text_statistics(cleaned(spark, folder)), 6, "mean", "median")


@query()
def usable_complaints(spark, folder):
    docs = complaints(spark, folder).withColumnsRenamed(
        {"complaint_id": "Complaint ID", cx.TEXT: "Consumer complaint narrative", "product": "Product", "issue": "Issue"}
    )
    prepared = cx.prepare_complaints(docs, ["Complaint ID"])
    return cx.complaint_view(prepared)


@query()
def lexicon_sentiment(spark, folder):
    return scored_complaints(spark, folder).select("complaint_id", "sentiment_score", "sentiment")


@query()
def lexicon_sentiment_raw(spark, folder):
    texts = tables.complaints(spark, folder, False)
    return cx.with_raw_sentiment(texts, POSITIVE, NEGATIVE).select("complaint_id", "sentiment")


@query()
def sentiment_distribution(spark, folder):
    found = reports.value_counts(scored_complaints(spark, folder), "sentiment", "complaints")
    return rounded(found, 6, "percentage")


@query()
def sentiment_by_product(spark, folder):
    return rounded(cx.sentiment_by(scored_complaints(spark, folder), "product", positive=True), 6, "negative_rate")


@query()
def sentiment_by_channel(spark, folder):
    return rounded(cx.sentiment_by(scored_complaints(spark, folder), "submitted_via"), 6, "negative_rate")


@query()
def complaint_categories(spark, folder):
    return rounded(cx.sentiment_by(scored_complaints(spark, folder), "product", "issue"), 6, "negative_rate")


@query()
def channel_sample(spark, folder):
    found = cx.channel_sample(tables.complaints(spark, folder, False), "issue", ["complaint_id"], CHANNEL_ROWS)
    return found.select("complaint_id", "issue", "product")


@query()
def channel_sample_default(spark, folder):
    """The operator's own 5,000 rows a channel."""
    found = cx.channel_sample(tables.complaints(spark, folder, False), "issue", ["complaint_id"])
    return found.select("complaint_id", "issue", "product")


@query()
def channel_counts(spark, folder):
    return cx.channel_counts(complaints(spark, folder), "submitted_via")


@query()
def tfidf_top_terms(spark, folder):
    return tfidf.corpus_terms(cleaned(spark, folder), "complaint_id", **TFIDF_OPTIONS)


@query()
def tfidf_negative(spark, folder):
    scored = cx.with_sentiment(cleaned(spark, folder), POSITIVE, NEGATIVE)
    return tfidf.negative_terms(scored, "complaint_id", **NEGATIVE_OPTIONS)


def topic_weights(spark, folder):
    return complaint_text.build_topic_weights(spark, folder, STOP_WORDS)


@query()
def tfidf_sublinear(spark, folder):
    return rounded(topic_weights(spark, folder), 9, "weight")


@query()
def json_hits(spark, folder):
    events = tables.table(spark, folder, "events")
    record = F.struct(
        F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.from_json("props", "k long")["k"].cast("string").alias("k"),
    )
    reply = F.concat(F.lit('{"hits":[{"_source":'), F.to_json(record), F.lit("},"), F.to_json(record), F.lit("]}"))
    return readers.parse_hits(events.select(reply.alias("reply")), "reply", "event_id string, event_type string, k string")


# ---- themes -------------------------------------------------------------------------------------


def themes(spark, folder):
    return complaint_text.build_themed(spark, folder, POSITIVE, NEGATIVE)


def plain_themes(spark, folder):
    """Themes and response flags without reading the texts."""
    return cx.with_theme(complaints(spark, folder))


RATES = ["negative_rate", "positive_rate", "timely_response_rate", "volume_share"]


@query()
def theme_metrics(spark, folder):
    return rounded(cx.theme_metrics(themes(spark, folder)), 6, *RATES)


@query()
def cx_priority(spark, folder):
    found = cx.theme_priority(cx.theme_metrics(themes(spark, folder)))
    return rounded(found, 6, *RATES, "volume_score", "negative_score", "response_gap_score", "cx_priority_score")


@query()
def cx_kpis(spark, folder):
    return rounded(cx.priority_kpis(cx.theme_priority(cx.theme_metrics(themes(spark, folder)))), 6, "top_score")


@query()
def product_theme(spark, folder):
    return rounded(cx.theme_by(themes(spark, folder), "product"), 6, "negative_rate")


@query()
def issue_theme(spark, folder):
    return rounded(cx.theme_by(themes(spark, folder), "issue"), 6, "negative_rate")


@query()
def topic_distribution(spark, folder):
    return rounded(cx.topic_distribution(complaints(spark, folder)), 6, "percentage")


@query()
def topic_share(spark, folder):
    found = cx.share_within(complaints(spark, folder), "product", "dominant_topic", "topic_share_pct", total="product_total")
    return rounded(found, 6, "topic_share_pct")


@query()
def topic_by_issue(spark, folder):
    return reports.group_sizes(complaints(spark, folder), "issue", "dominant_topic", out="complaints")


@query()
def topic_by_response(spark, folder):
    return reports.group_sizes(complaints(spark, folder), "dominant_topic", "timely_response", out="complaints")


@query()
def crosstab(spark, folder):
    return contingency.crosstab(plain_themes(spark, folder), "product", "theme")


@query()
def chi_square_stat(spark, folder):
    found = contingency.chi_square(plain_themes(spark, folder), "product", "theme")
    return rounded(found, 6, "chi_square", "cramers_v")


@query()
def timeliness_chi_square_stat(spark, folder):
    found = contingency.chi_square(plain_themes(spark, folder), "theme", "timely_yes")
    return rounded(found, 6, "chi_square", "cramers_v")


@query()
def yates_chi_square_stat(spark, folder):
    flagged = plain_themes(spark, folder).withColumn("channel_known", F.col("submitted_via").isNotNull())
    found = contingency.chi_square(flagged, "channel_known", "timely_yes")
    return rounded(found, 6, "chi_square", "cramers_v")


@query()
def chi_square_tests(spark, folder):
    found = plain_themes(spark, folder)
    first = contingency.chi_square_test(found, "theme", "timely_yes", "CX theme vs response timeliness")
    both = first.unionByName(contingency.chi_square_test(found, "product", "theme", "Product vs CX theme"))
    return rounded(both, 6, "chi_square", "p_value", "cramers_v")


@query()
def wilson_ci(spark, folder):
    found = contingency.late_response_rates(plain_themes(spark, folder))
    return rounded(found, 6, "not_timely_rate_pct", "ci_95_lower_pct", "ci_95_upper_pct")


@query()
def response_performance(spark, folder):
    return rounded(cx.response_performance(plain_themes(spark, folder)), 6, "timely_rate_pct", "not_timely_rate_pct")


@query()
def residuals(spark, folder):
    return contingency.residuals(plain_themes(spark, folder), "product", "theme")


@query()
def friction_points(spark, folder):
    return contingency.friction_points(contingency.residuals(plain_themes(spark, folder), "issue", "theme"), 20)


@query()
def friction_matrix(spark, folder):
    found = contingency.friction_matrix(contingency.residuals(plain_themes(spark, folder), "issue", "theme"))
    names = [c for c in found.columns if c != "issue"]
    cells = F.array(*[F.struct(F.lit(n).alias("theme"), F.col(f"`{n}`").alias("residual")) for n in names])
    return found.select("issue", F.explode(cells).alias("c")).select("issue", "c.theme", "c.residual")


@query()
def theme_concentration(spark, folder):
    known = plain_themes(spark, folder).where(F.col("product").isNotNull())
    return rounded(cx.share_within(known, "product", "theme", "theme_share_pct"), 6, "theme_share_pct")


# ---- statistics ---------------------------------------------------------------------------------


@query()
def describe_metrics(spark, folder):
    return rounded(statistics.describe_metrics(c360(spark, folder)), 6, "mean", "median", "std", "min", "max")


@query()
def describe_metrics_ci(spark, folder):
    return statistics.describe_with_interval(c360(spark, folder))


MOMENTS = ["mean1", "mean2", "difference", "t_statistic", "degrees_of_freedom", "cohens_d"]


def moments_view(df, *more):
    return rounded(df, 6, *MOMENTS).select("metric", "n1", "n2", *MOMENTS, "effect_interpretation", *more)


def tests_view(df, *more):
    return moments_view(rounded(df, 6, "p_value"), "p_value", "statistically_significant", *more)


@query()
def welch_moments(spark, folder):
    return moments_view(statistics.returns_moments(c360(spark, folder)))


@query()
def risk_group_moments(spark, folder):
    return moments_view(statistics.risk_group_moments(c360(spark, folder)))


@query()
def returns_vs_health(spark, folder):
    return tests_view(statistics.returns_vs_health(c360(spark, folder)), "conclusion")


@query()
def risk_group_tests(spark, folder):
    return tests_view(statistics.risk_group_tests(c360(spark, folder)))


@query()
def spearman_matrix(spark, folder):
    return rounded(statistics.spearman(c360(spark, folder), "customer_id"), 9, "correlation")


@query()
def dq_checks(spark, folder):
    return quality.customer_checks(c360(spark, folder))


@query()
def ols_health(spark, folder):
    found = rounded(statistics.health_regression(c360(spark, folder)), 9, "coefficient", "std_error")
    return rounded(found, 6, "p_value", "r_squared")


def odds_view(found):
    return rounded(rounded(found, 8, "coefficient", "std_error"), 6, "p_value", "odds_ratio", "ci_lower", "ci_upper")


@query()
def logit_odds_ratios(spark, folder):
    return odds_view(statistics.churn_regression(c360(spark, folder)))


@query()
def logit_odds_of_habits(spark, folder):
    """Odds without the days since the last order, which tell churned customers apart on most data."""
    return odds_view(statistics.churn_regression(c360(spark, folder), features=HABITS))


# ---- churn models -------------------------------------------------------------------------------


@query()
def stratified_split(spark, folder):
    base = chain.build_churn_base(spark, folder).select("customer_id", "churned")
    return modelling.stratified_split(base)


@query()
def seeded_sample(spark, folder):
    return modelling.seeded_sample(chain.build_churn_base(spark, folder).select("customer_id", "obs_total_revenue"), 1000)


def curve_counts(spark, folder):
    found = churn.recency_score(chain.build_churn_base(spark, folder))
    return modelling.threshold_counts(found, "actual_churned", "churn_probability")


@query()
def roc_curve(spark, folder):
    return modelling.roc_curve(curve_counts(spark, folder))


@query()
def pr_curve(spark, folder):
    return modelling.precision_recall_curve(curve_counts(spark, folder))


@query()
def churn_metrics(spark, folder):
    found = churn.recency_score(chain.build_churn_base(spark, folder))
    return modelling.evaluate(found, "actual_churned", "churn_probability", "predicted_churned")


@query()
def linear_contributions(spark, folder):
    found = modelling.linear_contributions(chain.build_churn_base(spark, folder), "customer_id", CONTRIBUTION_WEIGHTS)
    return rounded(found, 6, "phi")


@query()
def risk_explanations(spark, folder):
    base = chain.build_churn_base(spark, folder)
    top = modelling.top_risk(churn.recency_score(base), base)
    return top.select("customer_id", "churn_probability", "risk_tier", modelling.rule_explanation().alias("explanation"))


_models: dict = {}


def churn_split(spark, folder):
    return stage(spark, folder, "churn_split", lambda: modelling.stratified_split(chain.build_churn_base(spark, folder)))


def model(spark, folder, name):
    """The named model on the training share, fitted once per application."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _models:
        train = churn_split(spark, folder).where("is_train = 1")
        _models[key] = modelling.fit_models(train, [name])[name]
    return _models[key]


def linear_model(spark, folder):
    return model(spark, folder, "Logistic Regression")


def compared(spark, folder, names):
    fitted = {name: model(spark, folder, name) for name in names}
    return modelling.compare_models(fitted, churn_split(spark, folder).where("is_train = 0"))


@query()
def logistic_metrics(spark, folder):
    return compared(spark, folder, ["Logistic Regression"]).drop("is_best")


@query()
def forest_metrics(spark, folder):
    return compared(spark, folder, ["Random Forest"]).drop("is_best")


@query()
def boosting_metrics(spark, folder):
    return compared(spark, folder, ["Gradient Boosting"]).drop("is_best")


@query()
def churn_model_compare(spark, folder):
    return compared(spark, folder, modelling.MODEL_NAMES)


@query()
def churn_model_predictions(spark, folder):
    return modelling.churn_predictions(linear_model(spark, folder), chain.build_churn_base(spark, folder))


@query()
def customer_360_from_model(spark, folder):
    """Customer 360 with the probabilities of the fitted model."""
    return chain.build_customer_360(spark, folder, churn_model_predictions(spark, folder))


@query()
def feature_importance(spark, folder):
    return modelling.feature_importance(model(spark, folder, "Random Forest"))


@query()
def coefficient_drivers(spark, folder):
    return modelling.top_drivers(modelling.signed_drivers(modelling.coefficient_rows(linear_model(spark, folder))))


@query()
def model_risk_explanations(spark, folder):
    base, fitted = chain.build_churn_base(spark, folder), linear_model(spark, folder)
    top = modelling.top_risk(modelling.churn_predictions(fitted, base), base)
    drivers = modelling.top_contributions(modelling.model_contributions(fitted, base, keys=top))
    return top.join(drivers, "customer_id", "left")


# ---- vectors, topics and classifiers ------------------------------------------------------------


@query()
def concept_vectors(spark, folder):
    found = tables.table(spark, folder, "embeddings")
    centroids = vectors.group_centroids(found, "label", "embedding")
    near = vectors.nearest(found, "vec_id", "embedding", centroids.withColumnRenamed("label", "concept"), 15, "concept", False)
    return rounded(near, 6, "similarity")


@query()
def similar_vectors(spark, folder):
    found = tables.table(spark, folder, "embeddings")
    queries = found.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query"), F.min("vec_id").alias("target")).drop("label")
    near = vectors.nearest(found, "vec_id", "embedding", queries, 10, "target", True)
    return rounded(near, 6, "similarity")


def corpus_vectors(spark, folder):
    return stage(spark, folder, "word vectors", lambda: word_factors.co_occurrence_vectors(complaint_text.build_sentences(spark, folder)))


@query()
def word_context_totals(spark, folder):
    """Contexts and weight of every frequent word: what the word vectors are made of."""
    found = complaint_text.build_sentences(spark, folder)
    numbers = word_factors.numbered(word_factors.vocabulary(found))
    totals = word_factors.context_totals(word_factors.turned(word_factors.numbered_pairs(found, numbers)))
    return word_factors.with_words(totals, numbers, "word").select("word", "contexts", "weight")


CORPUS_CONCEPTS = {"articles": ["the", "les", "der"], "joining": ["and", "und", "avec"], "missing": ["unseen"]}


@query()
def word2vec_synonyms(spark, folder):
    return vectors.similar_words(corpus_vectors(spark, folder), ["the", "and", "der", "les", "unseen"])


@query()
def word2vec_concepts(spark, folder):
    return vectors.concept_neighbours(corpus_vectors(spark, folder), CORPUS_CONCEPTS)


_topic_models: dict = {}


def topic_model(spark, folder):
    key = (spark.sparkContext.applicationId, folder)
    if key not in _topic_models:
        _topic_models[key] = topics.fit_topics(topic_weights(spark, folder), "complaint_id")
    return _topic_models[key]


@query()
def nmf_fit(spark, folder):
    """How the topics were found: rounds, first and last error, whether they settled and how many weight rows did not."""
    fitted, docs = topic_model(spark, folder)
    return docs.sparkSession.createDataFrame(
        [(len(fitted.components), len(fitted.terms), len(fitted.errors), fitted.errors[0], fitted.errors[-1], fitted.converged, fitted.unsettled)],
        "topics int, terms int, rounds int, first_error double, last_error double, converged boolean, unsettled int",
    )


@query()
def nmf_topic_terms(spark, folder):
    return topics.topic_terms(*topic_model(spark, folder))


@query()
def nmf_dominant_topic(spark, folder):
    fitted, docs = topic_model(spark, folder)
    weighed = topics.document_topics(fitted, docs, "complaint_id")
    return topics.assign_topics(complaint_text.build_redacted(spark, folder).select("complaint_id"), "complaint_id", weighed)


def load_lexicon():
    """A stand-in for a pre-trained classifier: the larger lexicon count decides."""
    positive, negative = frozenset(POSITIVE), frozenset(NEGATIVE)

    def predict(batch: list[str]) -> list[tuple[str, float]]:
        out = []
        for t in batch:
            found = t.lower().split()
            p, n = sum(w in positive for w in found), sum(w in negative for w in found)
            out.append(("POSITIVE" if p > n else "NEGATIVE", max(p, n) / (p + n) if p + n else 0.5))
        return out

    return predict


def classified(spark, folder):
    return cx.classify_texts(tables.complaints(spark, folder, False), cx.Predictor("lexicon", load_lexicon), ["complaint_id", "product", "issue"])


@query()
def batch_classifier(spark, folder):
    return rounded(classified(spark, folder), 6, "confidence").select("complaint_id", "predicted_label", "confidence", "sentiment")


@query()
def classifier_summary(spark, folder):
    return rounded(cx.classification_summary(classified(spark, folder)), 6, "mean_confidence", "percentage")


# ---- sinks and what they read back --------------------------------------------------------------


def sink(spark, name):
    """A new folder for one run in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query()
def raw_parts(spark, folder):
    """Raw lines written as CSV parts by year, read again under one another."""
    raw = tables.raw_transactions(spark, folder)
    late = F.year("InvoiceDate") >= 1995
    paths = [sink(spark, "raw-early"), sink(spark, "raw-late")]
    for path, part in zip(paths, (raw.where(~late), raw.where(late)), strict=True):
        writers.write_export(part, path)
    read = readers.read_raw_parts(spark, paths)
    out = read.groupBy("Country").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("Quantity").alias("quantity"), F.count("Description").alias("described"),
        F.count("Customer ID").alias("with_customer"), F.min("InvoiceDate").alias("first_date"),
    )
    return out.withColumnRenamed("Country", "country")


@query()
def parquet_sink(spark, folder):
    path = sink(spark, "customer-360")
    writers.write_table(c360(spark, folder), path, "health_tier")
    return readers.read_table(spark, path, ["customer_id", "health_tier"]).select("customer_id", "health_tier", "total_revenue", "action_priority")


@query()
def csv_report_sink(spark, folder):
    path, report = sink(spark, "report"), reports.health_tier_summary(c360(spark, folder))
    writers.write_report(report, path)
    return readers.read_csv(spark, path, report.schema)


@query()
def json_sink(spark, folder):
    path, report = sink(spark, "kpis"), reports.executive_kpis(c360(spark, folder))
    writers.write_json(report, path)
    return readers.read_json(spark, path, report.schema)


@query()
def format_parity(spark, folder):
    """Rows and columns of the same table read from CSV and from Parquet."""
    c = c360(spark, folder)
    paths = {"csv": sink(spark, "csv"), "parquet": sink(spark, "parquet")}
    writers.write_export(c, paths["csv"])
    writers.write_table(c, paths["parquet"])
    read = {"csv": readers.read_csv(spark, paths["csv"]), "parquet": readers.read_table(spark, paths["parquet"])}
    out = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("format"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in read.items()
    ]
    return out[0].unionByName(out[1])


@query()
def model_round_trip(spark, folder):
    """Customers scored by the fitted pipeline and by its stored copy: all of them, and those with the same probability."""
    path, base, fitted = sink(spark, "model"), chain.build_churn_base(spark, folder), linear_model(spark, folder)
    modelling.save_model(fitted, path)
    a, b = (modelling.score(m, base).select("customer_id", F.col("probability_of_churn").alias(p)) for m, p in ((fitted, "a"), (modelling.load_model(path), "b")))
    return a.join(b, "customer_id").agg(F.count(F.lit(1)).alias("customers"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same"))


@query()
def report_run(spark, folder):
    """All ten reports written to the shared folder; the shapes are those of the files."""
    sold = tables.sales(
        spark, folder,
        ["invoice_yearmonth", "stock_code", "description", "revenue", "quantity", "invoice_id", "customer_id", "unit_price"],
    )
    path = sink(spark, "reports")
    names = report_suite.run_reports(c360(spark, folder), sold, path).select("report").collect()  # ten names
    written = {r["report"]: readers.read_csv(spark, f"{path}/{r['report']}") for r in names}
    return quality.report_shapes(written, report_suite.ROW_LIMITS)


@query()
def customer_lookup(spark, folder):
    found = reports.score_profile(reports.customer_lookup(c360(spark, folder), LOOKED_UP))
    return rounded(found, 6, "health", "churn_safety")


def fitted_themes(spark, folder):
    """Themes from the fitted topics instead of the length of the text."""
    return stage(
        spark, folder, "themed by topics",
        lambda: complaint_text.build_themed(spark, folder, POSITIVE, NEGATIVE, nmf_dominant_topic(spark, folder)),
    )


@query()
def fitted_theme_metrics(spark, folder):
    return rounded(cx.theme_metrics(fitted_themes(spark, folder)), 6, *RATES)


@query()
def fitted_cx_priority(spark, folder):
    found = cx.theme_priority(cx.theme_metrics(fitted_themes(spark, folder)))
    return rounded(found, 6, *RATES, "volume_score", "negative_score", "response_gap_score", "cx_priority_score")


@query()
def fitted_theme_tables(spark, folder):
    """Complaints and negative rate of each theme by product and by issue."""
    found = [
        cx.theme_by(fitted_themes(spark, folder), dim).select(F.lit(dim).alias("dimension"), F.col(dim).alias("value"), "theme", "complaints", "negative_complaints", "negative_rate")
        for dim in ("product", "issue")
    ]
    return rounded(found[0].unionByName(found[1]), 6, "negative_rate")


@query()
def fitted_topic_shares(spark, folder):
    """Shares of the fitted topics: of all complaints, and of each product's."""
    found = fitted_themes(spark, folder)
    overall = cx.topic_distribution(found).select(F.lit(None).cast("string").alias("product"), F.col("topic_id").alias("dominant_topic"), "complaints", F.col("percentage").alias("share_pct"))
    within = cx.share_within(found, "product", "dominant_topic", "share_pct").select("product", "dominant_topic", "complaints", "share_pct")
    return rounded(overall.unionByName(within), 6, "share_pct")
