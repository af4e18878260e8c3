"""Audits, profiles and rule checks, each as one aggregate over its table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions.fixed_values import CLEAN_COLUMNS, RAW_COLUMN_NAMES
from patronage.functions.numeric import money_sum, ratio
from patronage.operators.cleaning import is_cancellation
from patronage.operators.sales import line_sizes
from patronage.session import pin


def as_rows(one_row: DataFrame, name: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Turn the columns of a one-row frame into (name, value) rows."""
    rows = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns])
    return one_row.select(F.explode(rows).alias("r")).select("r.*")


def null_profile(df: DataFrame) -> DataFrame:
    """Null count of every column: (column_name, nulls)."""
    counts = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns])
    return as_rows(counts, "column_name", "nulls", df.columns)


def table_profile(df: DataFrame, date: str) -> DataFrame:
    """Per column: type, rows of the table, nulls, and the date range of the table."""
    measures = [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"_null_{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("date_min"), F.max(date).alias("date_max"), *measures)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(f"_null_{i}").alias("nulls"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return one.select("rows", "date_min", "date_max", F.explode(F.array(*entries)).alias("c")).select(
        "c.*", "rows", "date_min", "date_max"
    )


def sample_rows(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(n)


def raw_audit(raw: DataFrame) -> DataFrame:
    """Faults and sizes of the raw lines as (check, value) text rows.

    Equal rows are folded and stored with their copies, so that the raw lines are read once; all counts read the columns
    that they need from there, folded to invoices or products.
    """
    names = list(RAW_COLUMN_NAMES)
    folded = pin(raw.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_n")))
    conditions = {f"null_{c}": F.col(f"`{c}`").isNull() for c in names}
    conditions |= {
        "quantity_negative": F.col("Quantity") < 0,
        "quantity_zero": F.col("Quantity") == 0,
        "price_negative": F.col("Price") < 0,
        "price_zero": F.col("Price") == 0,
        "missing_customer_id": F.col("Customer ID").isNull(),
        "cancelled_invoices": is_cancellation("Invoice"),
    }
    measures = {name: ("sum", F.sum(F.when(condition, F.col("_n")))) for name, condition in conditions.items()}
    measures |= {
        "total_rows": ("sum", F.sum("_n")), "_different": ("count", F.count(F.lit(1))),
        "date_min": ("min", F.min("InvoiceDate")), "date_max": ("max", F.max("InvoiceDate")),
    }
    found = line_sizes(folded, "Invoice", "Customer ID", "StockCode", "Country", measures)
    sized = found.withColumn("duplicate_rows", F.coalesce(F.col("total_rows") - F.col("_different"), F.lit(0)))
    dates = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("date_min", "date_max")}
    order = [*conditions, "duplicate_rows", "unique_customers", "unique_invoices", "unique_products", "unique_countries", "total_rows"]
    text = sized.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("string").alias(c) for c in order], *[d.alias(c) for c, d in dates.items()])
    found = as_rows(text, "check", "value", [*order, *dates])
    return found.where(~(F.col("check").startswith("null_") & (F.col("value") == "0")))


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule: (rule, violations, passed). Each rule states what a good row meets."""
    broken = [F.count(F.when(~F.coalesce(good, F.lit(False)), 1)).alias(name) for name, good in rules.items()]
    found = as_rows(df.agg(*broken), "rule", "violations", list(rules))
    return found.withColumn("passed", F.col("violations") == 0)


def _folded_with_rules(clean: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    no_null = F.lit(True)
    for c in CLEAN_COLUMNS:
        no_null = no_null & F.col(c).isNotNull()
    folded = clean.groupBy(*CLEAN_COLUMNS).agg(F.count(F.lit(1)).alias("_n"))
    return folded, {
        "no_nulls": no_null,
        "quantity_positive": F.col("quantity") > 0,
        "unit_price_positive": F.col("unit_price") > 0,
        "revenue_positive": F.col("revenue") > 0,
        "no_cancellations": ~is_cancellation(),
        "no_duplicates": F.col("_n") == 1,
    }


def clean_rules(clean: DataFrame) -> DataFrame:
    """The rules a cleaned table must meet, among them no nulls and no equal rows."""
    return check_rules(*_folded_with_rules(clean))


def store_clean(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cleaned lines, stored once with the copies of equal rows as ``_n``, and the rules as ``clean_rules`` has them.

    The raw lines are read once: the rules read the stored rows. (Spark's ``Observation`` would count them while they are
    written, but a session that has used one can no longer send the closures of fitted ML models to its tasks.)
    """
    folded, rules = _folded_with_rules(clean)
    stored = pin(folded)
    return stored, check_rules(stored, rules)


def feature_rules(features: DataFrame) -> DataFrame:
    """Rules for the feature table, with the uniqueness of its key."""
    rules = {
        "customer_id_present": F.col("customer_id").isNotNull(),
        "revenue_positive": F.col("total_revenue") > 0,
        "invoices_at_least_one": F.col("total_invoices") >= 1,
        "quantity_positive": F.col("total_quantity") > 0,
        "recency_not_negative": F.col("recency_days") >= 0,
        "tenure_not_negative": F.col("customer_tenure_days") >= 0,
        "invoice_value_positive": F.col("average_invoice_value") > 0,
        "frequency_positive": F.col("purchase_frequency_per_month") > 0,
    }
    checked = check_rules(features, rules)
    return checked.unionByName(key_is_unique(features, "customer_id"))


def rfm_rules(rfm: DataFrame) -> DataFrame:
    """Score ranges, a segment and an action for everyone."""
    rules = {f"{c}_in_range": F.col(c).between(1, 5) for c in ("r_score", "f_score", "m_score")}
    rules |= {
        "segment_present": F.coalesce(F.col("rfm_segment"), F.lit("")) != "",
        "action_present": F.col("recommended_action").isNotNull(),
    }
    return check_rules(rfm, rules)


def key_is_unique(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key value, as a rule row."""
    extra = (F.count(F.lit(1)) - F.count_distinct(key)).alias("violations")
    return df.agg(extra).select(F.lit(f"{key}_unique").alias("rule"), "violations", (F.col("violations") == 0).alias("passed"))


def join_keeps_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Does a join keep the row count and the key unique? (rows_before, rows_after, keys_after, passed)."""
    left = before.agg(F.count(F.lit(1))).scalar()
    out = after.agg(F.count(F.lit(1)).alias("rows_after"), F.count_distinct(key).alias("keys_after"))
    same = (F.col("rows_before") == F.col("rows_after")) & (F.col("rows_after") == F.col("keys_after"))
    return out.withColumn("rows_before", left).withColumn("passed", same)


def reconcile(left: DataFrame, left_column: str, right: DataFrame, right_column: str, tolerance: float) -> DataFrame:
    """Do two tables carry the same money? (left_total, right_total, difference, passed)."""
    other = right.agg(money_sum(right_column)).scalar()
    out = left.agg(money_sum(left_column).alias("left_total")).withColumn("right_total", other)
    out = out.withColumn("difference", F.abs(F.col("left_total") - F.col("right_total")))
    return out.withColumn("passed", F.col("difference") < tolerance)


def same_shape(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row and column counts of two copies of a table, for instance CSV and Parquet."""
    other = right.agg(F.count(F.lit(1))).scalar()
    out = left.agg(F.count(F.lit(1)).alias("left_rows")).withColumn("right_rows", other)
    return out.select(
        "*",
        F.lit(len(left.columns)).alias("left_columns"),
        F.lit(len(right.columns)).alias("right_columns"),
        ((F.col("left_rows") == F.col("right_rows")) & F.lit(len(left.columns) == len(right.columns))).alias("passed"),
    )


def report_shapes(reports: dict[str, DataFrame], limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Row counts of reports against their allowed (min, max): (report, rows, passed)."""
    out = None
    for name, df in reports.items():
        low, high = limits.get(name, (1, 2**62))
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("report"), "rows", F.col("rows").between(low, high).alias("passed")
        )
        out = row if out is None else out.unionByName(row)
    return out


def key_metrics(clean: DataFrame) -> DataFrame:
    """Sizes, revenue and mean order value of the clean table in one row."""
    found = line_sizes(clean, "invoice_id", "customer_id", "stock_code", "country", {
        "total_rows": ("count", F.count(F.lit(1))), "date_min": ("min", F.min("invoice_date")), "date_max": ("max", F.max("invoice_date")),
        "_revenue": ("sum", F.sum(F.col("revenue").cast("decimal(20,4)"))),
    })
    return found.select(
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"), "unique_customers", "unique_invoices", "unique_products", "unique_countries",
        "date_min", "date_max", F.col("_revenue").cast("double").alias("total_revenue"),
        ratio(F.col("_revenue"), F.col("unique_invoices")).alias("avg_order_value"),
    )


def domain_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values of several columns in one pass: (column_name, value), sorted."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(rows).alias("r")).select("r.*")
    return values.where(F.col("value").isNotNull()).distinct().orderBy("column_name", "value")


def customer_checks(c360: DataFrame) -> DataFrame:
    """Missing values, return rates above one and unscored customers: (check, column, count, status)."""
    nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"_null_{c}") for c in c360.columns]
    one = c360.agg(
        *nulls,
        F.count(F.when(F.col("return_rate") > 1, 1)).alias("_above"),
        F.count(F.when(F.col("churn_risk_tier") == "Not Scored", 1)).alias("_unscored"),
    )

    def entry(check: str, column: str, count: Column, status: str) -> Column:
        return F.struct(
            F.lit(check).alias("check"), F.lit(column).alias("column"), count.alias("count"), F.lit(status).alias("status")
        )

    entries = [entry("Missing values", c, F.col(f"_null_{c}"), "Review") for c in c360.columns]
    entries.append(entry("Return rate above 100%", "return_rate", F.col("_above"), "Review metric definition"))
    entries.append(entry("Customers without churn score", "churn_risk_tier", F.col("_unscored"), "Expected / Excluded"))
    rows = one.select(F.explode(F.array(*entries)).alias("c")).select("c.*")
    return rows.where((F.col("check") != "Missing values") | (F.col("count") > 0))
