from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from patronage.functions import rules
from patronage.operators import churn, health, quality, reports, rfm
from patronage.plans import customer360 as chain, report_suite

SMALL = "/root/testdata/sf0.001"


def test_labels(spark, rows):
    days = {1: ["2024-01-05", "2024-02-01"], 2: ["2024-01-07"], 3: ["2024-02-03"], 4: ["2024-01-31", "2024-01-02"]}
    data = [(c, datetime.fromisoformat(d)) for c, ds in days.items() for d in ds]
    sales = spark.createDataFrame(data, "customer_id long, invoice_date timestamp_ntz")
    got = rows(churn.churn_labels(churn.purchase_spans(sales), "2024-02-01"), "customer_id")
    assert [(r["customer_id"], r["churned"]) for r in got] == [(1, 0), (2, 1), (4, 1)]
    assert got[0]["observation_start_date"] == date(2024, 1, 2) and got[0]["observation_end_date"] == date(2024, 1, 31)
    assert got[0]["prediction_start_date"] == date(2024, 2, 1) and got[0]["prediction_end_date"] == date(2024, 2, 3)
    sizes = {r["key_set"]: r["customers"] for r in rows(churn.key_sets(churn.purchase_spans(sales), "2024-02-01"))}
    assert sizes == {
        "observation": 3, "prediction": 2, "churned": 2, "retained": 1, "prediction_only": 1, "both": 1, "any": 4,
    }


def test_bucket_edges(spark):
    days = [-1, 0, 30, 31, 60, 61, 90, 91, 180, 181, 365, 366, None]
    df = spark.createDataFrame([(d,) for d in days], "d long")
    got = [r[0] for r in df.select(churn.recency_bucket(F.col("d"))).collect()]
    assert got == [
        None, "0-30d", "0-30d", "31-60d", "31-60d", "61-90d", "61-90d", "91-180d", "91-180d", "181-365d", "181-365d",
        "365+d", None,
    ]
    orders = spark.createDataFrame([(d,) for d in [0, 1, 2, 3, 4, 5, 6, 10, 11]], "d long")
    assert [r[0] for r in orders.select(churn.frequency_bucket(F.col("d"))).collect()] == [
        None, "1 invoice", "2-3", "2-3", "4-5", "4-5", "6-10", "6-10", "11+",
    ]


def test_risk_tier_edges_use_the_unrounded_probability(spark):
    df = spark.createDataFrame([(p,) for p in [0.29999, 0.3, 0.59999, 0.6, 0.79999, 0.8, None]], "p double")
    got = df.select(churn.risk_tier("p").alias("t"), F.round("p", 4).alias("r")).collect()
    assert [r["t"] for r in got] == [
        "Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk", "Critical Risk", None,
    ]


def test_health_and_value_tier_edges(spark):
    df = spark.createDataFrame([(v,) for v in [100.0, 80.0, 79.99, 60.0, 40.0, 39.99, 20.0, 19.99]], "v double")
    got = [r[0] for r in df.select(rules.at_least("v", health.HEALTH_TIERS, health.LOWEST_HEALTH_TIER)).collect()]
    assert got == ["Excellent", "Excellent", "Healthy", "Healthy", "Watchlist", "At Risk", "At Risk", "Critical"]


SEGMENTS = [
    ((5, 5, 5), "Champions"), ((1, 5, 5), "Cannot Lose"), ((3, 4, 3), "Loyal Customers"), ((3, 5, 5), "Loyal Customers"),
    ((5, 1, 5), "Big Spenders"), ((2, 3, 3), "At Risk"), ((2, 4, 3), "At Risk"), ((4, 2, 1), "Potential Loyalists"),
    ((5, 1, 2), "New Customers"), ((1, 1, 1), "Hibernating"), ((3, 1, 2), "Low Value"), ((3, 3, 3), "Needs Attention"),
]


def test_segment_rules(spark):
    df = spark.createDataFrame([s for s, _ in SEGMENTS], "r_score int, f_score int, m_score int")
    got = rfm.assign_segments(df).collect()
    assert [r["rfm_segment"] for r in got] == [name for _, name in SEGMENTS]
    assert got[0]["rfm_score"] == "555" and got[0]["rfm_total_score"] == 15 and got[0]["rfm_average_score"] == 5.0


def test_action_priority_order(spark):
    cases = [
        (("Critical", "Low Risk", "Champions", False), "Priority 1"), (("Healthy", "Critical Risk", "Champions", False), "Priority 1"),
        (("Healthy", "Low Risk", "At Risk", False), "Priority 2"), (("Healthy", "High Risk", "Low Value", True), "Priority 2"),
        (("Watchlist", "Low Risk", "Low Value", False), "Priority 3"), (("Healthy", "Low Risk", "New Customers", False), "Priority 3"),
        (("Excellent", "Low Risk", "Big Spenders", False), "Priority 4"), (("Healthy", "High Risk", "Low Value", False), "Priority 5"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "health_tier string, churn_risk_tier string, rfm_segment string, top boolean")
    assert [r[0] for r in df.select(health.action_priority(F.col("top"))).collect()] == [p for _, p in cases]


def test_unscored_customers_get_the_neutral_midpoint(spark):
    df = spark.createDataFrame([(15, 1, 0.25, 1), (15, 0, None, 0)], "rfm_total_score int, model_scored int, churn_probability double, is_repeat_buyer int")
    got = [r[0] for r in df.select(health.health_score(F.lit(1.0), F.lit(1.0))).collect()]
    assert got == [40 + 22.5 + 20 + 10, 40 + 15 + 20 + 5]


def test_tier_counts_fill_absent_tiers(spark, rows):
    df = spark.createDataFrame([("Healthy",), ("Healthy",), ("Critical",)], "health_tier string")
    got = rows(health.tier_counts(df).orderBy("ord"))
    assert [(r["health_tier"], r["customer_count"]) for r in got] == [
        ("Excellent", 0), ("Healthy", 2), ("Watchlist", 0), ("At Risk", 0), ("Critical", 1),
    ]


def test_monetary_bucket_falls_back_to_ranks(spark):
    base = spark.createDataFrame([(i, 5.0 if i < 8 else float(i)) for i in range(10)], "customer_id long, v double")
    got = churn.with_monetary_bucket(base, "v", "b").groupBy("b").count().collect()
    assert {r["b"]: r["count"] for r in got} == {b: 2 for b in ["Low", "Low-Mid", "Mid", "Mid-High", "High"]}


def test_leakage_check_finds_faults(spark, rows):
    base = spark.createDataFrame(
        [(1, 0, 1, datetime(2024, 2, 1), 3.0)],
        "customer_id long, churned int, purchased_in_prediction int, obs_last_purchase_date timestamp_ntz, total_revenue double",
    )
    got = {r["check"]: r["violations"] for r in rows(churn.leakage_check(base, "2024-02-01"))}
    assert got == {"forbidden_columns": 1, "unprefixed_columns": 1, "dates_after_cutoff": 1}


@pytest.fixture(scope="module")
def c360(spark):
    return chain.build_customer_360(spark, SMALL)


def test_customer_360_shape(spark, c360, rows):
    assert len(c360.columns) == 46 and "active_purchase_span_days" not in c360.columns
    checked = quality.join_keeps_rows(chain.build_features(spark, SMALL), c360, "customer_id").first()
    assert checked["passed"]
    assert all(r["passed"] for r in rows(quality.rfm_rules(chain.build_rfm(spark, SMALL))))


def test_filters_combine(c360):
    every = c360.count()
    assert reports.filter_customers(c360).count() == every
    only = reports.filter_customers(c360, scored=False)
    assert only.where("model_scored = 1").count() == 0
    spared = reports.filter_customers(c360, probability=(2.0, 3.0))
    assert spared.count() == c360.where("model_scored = 0").count()


def test_lookup_and_profile(c360):
    found = reports.score_profile(reports.customer_lookup(c360, 1)).collect()
    assert len(found) == 1 and 0.0 <= found[0]["churn_safety"] <= 5.0 and found[0]["health"] <= 5.0


def test_reports_agree_with_the_table(spark, c360):
    kpis = reports.executive_kpis(c360).first()
    tiers = reports.health_tier_summary(c360).toPandas()
    assert tiers["customer_count"].sum() == kpis["total_customers"] == c360.count()
    assert tiers["total_revenue"].sum() == pytest.approx(kpis["total_revenue"], abs=0.1)
    assert tiers["revenue_pct"].sum() == pytest.approx(100, abs=0.1)
    assert set(report_suite.CUSTOMER_REPORTS) | set(report_suite.SALES_REPORTS) >= {"executive_kpis", "monthly_revenue"}
