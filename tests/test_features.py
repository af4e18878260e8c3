from datetime import datetime

import pytest
from pyspark.sql import functions as F

from patronage.functions.fixed_values import FEATURE_COLUMNS
from patronage.operators import churn, features, quality

SALES = "customer_id long, invoice_id string, stock_code string, quantity long, invoice_date timestamp_ntz, revenue double, country string"


def at(text):
    return datetime.fromisoformat(text)


@pytest.fixture()
def sales(spark):
    data = [
        # one invoice across midnight, ties in country, two products
        (1, "a", "p", 2, at("2024-01-01 23:50:00"), 10.0, "Y"),
        (1, "a", "q", 1, at("2024-01-02 00:05:00"), 5.5, "X"),
        (1, "b", "p", 4, at("2024-01-10 12:00:00"), 8.25, "Y"),
        (1, "b", "p", 4, at("2024-01-10 12:00:00"), 8.25, "X"),
        # one purchase day only
        (2, "c", "r", 3, at("2024-03-01 08:00:00"), 30.0, "Z"),
        # only after the cutoff
        (3, "d", "p", 1, at("2024-04-01 10:00:00"), 1.0, "X"),
        (3, "e", "p", 1, at("2024-04-03 09:00:00"), 2.0, "X"),
    ]
    return spark.createDataFrame(data, SALES)


def test_customer_base(sales, rows):
    one, two, three = rows(features.customer_base(sales), "customer_id")
    assert one["total_invoices"] == 2 and one["total_line_items"] == 4 and one["total_quantity"] == 11
    assert one["unique_products"] == 2 and one["country_mode"] == "X"
    assert one["unique_purchase_days"] == 2  # days of the invoices' first lines
    assert one["avg_days_between_purchases"] == pytest.approx(9 / 2)  # three line days
    assert (one["max_invoice_value"], one["min_invoice_value"], one["total_revenue"]) == (16.5, 15.5, 32.0)
    assert two["avg_days_between_purchases"] == 0.0 and two["first_purchase_date"] == two["last_purchase_date"]
    assert three["avg_days_between_purchases"] == 2.0


def test_base_agrees_with_the_single_operators(sales, rows):
    base = features.customer_base(sales)
    invoices = features.invoice_rollup(sales)
    frequency = rows(features.frequency_features(sales), "customer_id")
    for got, want in zip(rows(base, "customer_id"), frequency):
        for c in ("total_invoices", "total_line_items", "total_quantity", "unique_products"):
            assert got[c] == want[c]
    for got, want in zip(rows(base, "customer_id"), rows(features.revenue_features(invoices), "customer_id")):
        assert all(got[c] == v for c, v in want.items())
    for got, want in zip(rows(base, "customer_id"), rows(features.purchase_gap(sales), "customer_id")):
        assert got["avg_days_between_purchases"] == want["avg_days_between_purchases"]
    modes = rows(features.most_frequent(sales, "customer_id", "country", "country_mode"), "customer_id")
    assert [r["country_mode"] for r in modes] == ["X", "Z", "X"]


def test_gaps_telescope(sales, rows):
    gaps = [r["gap_days"] for r in rows(features.purchase_gaps(sales.where("customer_id = 1")), "purchase_day")]
    assert gaps == [None, 1, 8]


def test_window_measures_match_a_filtered_pass(spark, sales, rows):
    cutoff = "2024-01-10"
    whole = features.customer_base(sales, churn.observation_window(cutoff))
    seen = whole.where("obs_total_invoices > 0")
    alone = features.customer_base(churn.observation(sales, cutoff))
    assert [r["customer_id"] for r in rows(seen, "customer_id")] == [r["customer_id"] for r in rows(alone, "customer_id")]
    for got, want in zip(rows(seen, "customer_id"), rows(alone, "customer_id")):
        assert {c: got[f"obs_{c}"] for c in want if c not in ("customer_id", "last_line_date")} == {
            c: v for c, v in want.items() if c not in ("customer_id", "last_line_date")
        }


def test_customer_features(spark, sales, rows):
    returns = spark.createDataFrame(
        [(1, "C1", -3), (1, "C2", -1), (9, "C3", -5), (None, "C4", -5)], "customer_id long, invoice_id string, quantity long"
    )
    table = features.customer_features(features.customer_base(sales), returns)
    assert table.columns == FEATURE_COLUMNS
    one, two, three = rows(table, "customer_id")
    assert (one["total_returns"], one["return_quantity_abs"], one["has_returned"], one["return_rate"]) == (2, 4, 1, 1.0)
    assert (two["total_returns"], two["has_returned"], two["return_rate"], two["is_repeat_buyer"]) == (0, 0, 0.0, 0)
    # snapshot is a day after the last line; elapsed blocks of 24 hours, not calendar days
    assert three["recency_days"] == 1 and three["customer_tenure_days"] == 1
    assert one["recency_days"] == 84
    assert three["purchase_frequency_per_month"] == 2.0  # less than a month counts as one
    assert all(r["passed"] for r in rows(quality.feature_rules(table)))


def test_ratios_of_a_published_customer(spark):
    made = spark.createDataFrame(
        [(400, 12, 34, 74285, 27, 77556.46)],
        "customer_tenure_days long, total_invoices long, total_line_items long, total_quantity long, unique_products long, total_revenue double",
    )
    got = made.withColumns(features.ratio_features()).first()
    assert got["average_invoice_value"] == 6463.038333333334
    assert got["average_line_revenue"] == 2281.0723529411766
    assert got["average_unit_price"] == 1.04403930807027
    assert got["purchase_frequency_per_month"] == pytest.approx(0.9)
    assert got["quantity_per_invoice"] == 6190.416666666667 and got["products_per_invoice"] == 2.25


def test_return_features_only_for_known_customers(spark, rows):
    returns = spark.createDataFrame([(1, "C1", -3), (2, "C2", -1)], "customer_id long, invoice_id string, quantity long")
    known = spark.createDataFrame([(2,), (3,)], "customer_id long")
    assert rows(features.return_features(returns, known)) == [
        {"customer_id": 2, "total_returns": 1, "return_quantity_abs": 1, "has_returned": 1}
    ]


def test_hot_customer(spark, rows):
    """A customer with most of the lines gives the same numbers as plain arithmetic."""
    lines = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("customer_id"),
        F.col("id").cast("string").alias("invoice_id"), (F.col("id") % 40).cast("string").alias("stock_code"),
        F.lit(1).cast("long").alias("quantity"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 5)).alias("invoice_date"),
        F.lit(0.1).alias("revenue"), F.lit("X").alias("country"),
    )
    hot = rows(features.customer_base(lines).where("customer_id = -1"))[0]
    assert hot["total_invoices"] == 2000 and hot["unique_products"] == 40 and hot["unique_purchase_days"] == 5
    assert hot["total_revenue"] == 200.0
