from datetime import datetime

import pytest

from patronage.functions.fixed_values import CLEAN_COLUMNS, RAW_COLUMN_NAMES
from patronage.operators import cleaning, quality, sales
from patronage.sources import readers, writers

T0 = datetime(2010, 1, 5, 9, 30)


@pytest.fixture()
def raw(spark):
    good = ("489434", "85048", "GLASS BALL", 12, T0, 6.95, 13085.0, "United Kingdom")
    data = [
        good, good,
        ("489435", "79323P", "CHERRY LIGHTS", 2, T0, 6.75, None, "France"),
        ("C489436", "85048", "GLASS BALL", -1, T0, 6.95, 13085.0, "United Kingdom"),
        ("489437", "21232", "BOX", 0, T0, 1.0, 13085.0, "France"),
        ("489438", "21232", "BOX", 3, T0, 0.0, 13086.0, "France"),
        ("489439", "21232", None, 3, T0, 1.5, 13086.0, "France"),
        ("489440", "21232", "BOX", 3, T0, -1.5, None, "France"),
    ]
    return spark.createDataFrame(data, readers.RAW_SCHEMA)


def test_clean_and_returns(raw, rows):
    clean = cleaning.clean_transactions(raw)
    assert clean.columns == CLEAN_COLUMNS
    (row,) = rows(clean)
    assert row["customer_id"] == 13085 and row["revenue"] == pytest.approx(83.4)
    assert (row["invoice_year"], row["invoice_month"], row["invoice_yearmonth"], row["invoice_date_only"]) == (
        2010, 1, "2010-01", "2010-01-05",
    )
    assert [r["invoice_id"] for r in rows(cleaning.returned_lines(raw))] == ["C489436"]
    assert all(r["passed"] for r in rows(quality.clean_rules(clean)))


def test_step_counts_use_the_first_reason(raw, rows):
    got = {r["step"]: r["rows"] for r in rows(cleaning.cleaning_steps(raw))}
    assert got == {
        "raw": 8, "duplicates": 1, "returns": 1, "missing_customer": 2, "bad_quantity": 1, "bad_price": 1,
        "missing_description": 1, "clean": 1,
    }


def test_audit(raw, rows):
    got = {r["check"]: r["value"] for r in rows(quality.raw_audit(raw))}
    assert got["duplicate_rows"] == "1" and got["null_Customer ID"] == "2" and got["null_Description"] == "1"
    assert "null_Country" not in got
    assert (got["quantity_negative"], got["quantity_zero"], got["price_negative"], got["price_zero"]) == ("1", "1", "1", "1")
    assert got["cancelled_invoices"] == "1" and got["unique_customers"] == "2" and got["total_rows"] == "8"
    assert got["date_min"] == "2010-01-05 09:30:00"


def test_clean_rules_report_violations(spark, raw, rows):
    clean = cleaning.clean_transactions(raw)
    broken = clean.unionByName(clean).withColumn("quantity", -clean["quantity"])
    got = {r["rule"]: r["violations"] for r in rows(quality.clean_rules(broken))}
    assert got["no_duplicates"] == 1 and got["quantity_positive"] == 1 and got["no_cancellations"] == 0


def test_dedup_keeps_the_first(spark, rows):
    df = spark.createDataFrame([(k, o) for o in range(50) for k in ("hot", f"k{o % 3}")], "k string, o int")
    got = rows(cleaning.dedup_keep_first(df, ["k"], ["o"]), "k")
    assert [(r["k"], r["o"]) for r in got] == [("hot", 0), ("k0", 0), ("k1", 1), ("k2", 2)]


def test_require_and_pick_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="missing columns"):
        readers.require_columns(df, ["a", "c"])
    assert readers.keep_available(df, ["b", "x", "a"]).columns == ["b", "a"]
    assert readers.first_present(df, ["x", "b", "a"]) == "b" and readers.first_present(df, ["x"]) is None


def test_csv_and_parquet_copies_agree(spark, raw, tmp_path):
    clean = cleaning.clean_transactions(raw)
    writers.write_table(clean, str(tmp_path / "t"))
    writers.write_report(clean, str(tmp_path / "c"))
    stored = readers.read_table(spark, str(tmp_path / "t"), CLEAN_COLUMNS)
    copy = readers.read_csv(spark, str(tmp_path / "c"), stored.schema)
    assert quality.same_shape(copy, stored).first()["passed"]
    assert copy.collect() == stored.collect()
    assert quality.reconcile(copy, "revenue", stored, "revenue", 0.02).first()["passed"]


def test_raw_parts_from_csv(spark, raw, tmp_path):
    for part in ("p1", "p2"):
        writers.write_report(raw, str(tmp_path / part))
    both = readers.read_raw_parts(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert both.count() == 16 and both.columns == list(RAW_COLUMN_NAMES)
    parquet = [str(tmp_path / p) for p in ("q1", "q2")]
    for p in parquet:
        writers.write_table(raw, p)
    assert readers.read_raw_parts(spark, parquet, "parquet").count() == 16


def test_json_report_and_export(spark, raw, tmp_path):
    writers.write_json(quality.raw_audit(raw), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == quality.raw_audit(raw).count()
    writers.write_export(raw.withColumnsRenamed(RAW_COLUMN_NAMES), str(tmp_path / "e"))
    assert readers.read_csv(spark, str(tmp_path / "e")).count() == 8


def test_csv_text_with_quotes_and_newlines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text\n1,"two\nlines, ""quoted"""\n2,plain\n', encoding="utf-8")
    got = readers.read_csv(spark, str(path), "id long, text string", multi_line=True).orderBy("id").collect()
    assert got[0]["text"] == 'two\nlines, "quoted"' and got[1]["text"] == "plain"


def test_hits_wrapped_or_not(spark, tmp_path, rows):
    path = tmp_path / "reply.json"
    path.write_text(
        '{"hits": [{"_source": {"complaint_id": "1", "product": "Loan"}},\n'
        ' {"complaint_id": "2", "issue": "Fees", "complaint_what_happened": "text"}]}'
    )
    got = rows(readers.read_hits(spark, str(path)), "complaint_id")
    assert [(r["complaint_id"], r["product"], r["issue"]) for r in got] == [("1", "Loan", None), ("2", None, "Fees")]


def test_report_writer_and_shapes(spark, raw, tmp_path, rows):
    clean = cleaning.clean_transactions(raw)
    reports = {"months": sales.monthly_report(clean), "products": sales.product_report(clean)}
    assert writers.write_reports(reports, str(tmp_path)) == ["months", "products"]
    assert readers.read_csv(spark, str(tmp_path / "months")).count() == 1
    checked = rows(quality.report_shapes(reports, {"products": (2, 5)}), "report")
    assert [(r["rows"], r["passed"]) for r in checked] == [(1, True), (1, False)]


def test_order_metrics(spark, rows):
    lines = spark.createDataFrame(
        [("a", 1, "2010-01", 10.0, 1), ("a", 1, "2010-01", 2.5, 1), ("b", 2, "2010-01", 7.5, 2), ("c", 2, "2010-02", 100.0, 5)],
        "invoice_id string, customer_id long, invoice_yearmonth string, revenue double, quantity long",
    )
    got = sales.revenue_metrics(lines).first()
    assert (got["total_revenue"], got["total_quantity"], got["total_invoices"]) == (120.0, 9, 3)
    assert got["avg_order_value"] == 40.0 and got["median_order_value"] == 12.5
    trend = {r["invoice_yearmonth"]: r["avg_order_value"] for r in rows(sales.order_value_trend(lines))}
    report = {r["invoice_month"]: r["avg_order_value"] for r in rows(sales.monthly_report(lines))}
    assert trend == report == {"2010-01": 10.0, "2010-02": 100.0}
    behaviour = sales.repeat_behaviour(lines).first()
    assert (behaviour["repeat_customers"], behaviour["one_time_customers"]) == (1, 1)
    assert behaviour["repeat_revenue"] == 107.5 and behaviour["one_time_revenue"] == 12.5
    peak = sales.peak_and_low(sales.revenue_by(lines, "invoice_yearmonth"), "invoice_yearmonth", "total_revenue").first()
    assert peak["peak_invoice_yearmonth"] == "2010-02" and peak["low_total_revenue"] == 20.0


def test_profiles(spark, raw, rows):
    profile = {r["column_name"]: r for r in rows(quality.table_profile(raw, "InvoiceDate"))}
    assert profile["Description"]["nulls"] == 1 and profile["Price"]["data_type"] == "double" and profile["Price"]["rows"] == 8
    assert {r["column_name"]: r["nulls"] for r in rows(quality.null_profile(raw))}["Customer ID"] == 2
    assert [r["value"] for r in rows(quality.domain_values(raw, ["Country"]))] == ["France", "United Kingdom"]
    assert len(quality.sample_rows(raw, ["Invoice"]).collect()) == 3
