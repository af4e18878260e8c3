"""Per-customer features from transaction lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.fixed_values import FEATURE_COLUMNS
from patronage.functions.numeric import MONEY, elapsed_days, ratio
from patronage.functions.rules import flag

SALES_COLUMNS = ["customer_id", "invoice_id", "stock_code", "quantity", "invoice_date", "revenue", "country"]
RETURN_COLUMNS = ["customer_id", "invoice_id", "quantity"]


def invoice_rollup(sales: DataFrame) -> DataFrame:
    """One row per customer and invoice: earliest date, revenue, quantity, line count."""
    return sales.groupBy("customer_id", "invoice_id").agg(
        F.min("invoice_date").alias("invoice_date"),
        F.sum(F.col("revenue").cast(MONEY)).cast("double").alias("invoice_revenue"),
        F.sum("quantity").alias("invoice_qty"),
        F.count("revenue").alias("invoice_lines"),
    )


def date_features(invoices: DataFrame, snapshot: Column) -> DataFrame:
    """First and last purchase, tenure and recency in whole days before ``snapshot``."""
    spans = invoices.groupBy("customer_id").agg(
        F.min("invoice_date").alias("first_purchase_date"), F.max("invoice_date").alias("last_purchase_date")
    )
    tenure = elapsed_days(F.col("first_purchase_date"), F.col("last_purchase_date"))
    return spans.select(
        "*",
        tenure.alias("customer_tenure_days"),
        elapsed_days(F.col("last_purchase_date"), snapshot).alias("recency_days"),
        tenure.alias("active_purchase_span_days"),
    )


def snapshot_after(sales: DataFrame) -> Column:
    """The day after the last line, as a scalar subquery."""
    return sales.agg(F.max("invoice_date") + F.expr("INTERVAL 1 DAY")).scalar()


def frequency_features(sales: DataFrame) -> DataFrame:
    """Invoices, lines, quantity, products and purchase days per customer."""
    return sales.groupBy("customer_id").agg(
        F.count_distinct("invoice_id").alias("total_invoices"),
        F.count("invoice_id").alias("total_line_items"),
        F.sum("quantity").alias("total_quantity"),
        F.count_distinct("stock_code").alias("unique_products"),
        F.count_distinct(F.to_date("invoice_date")).alias("unique_purchase_days"),
    )


def revenue_features(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("customer_id").agg(
        F.sum(F.col("invoice_revenue").cast(MONEY)).cast("double").alias("total_revenue"),
        F.max("invoice_revenue").alias("max_invoice_value"),
        F.min("invoice_revenue").alias("min_invoice_value"),
    )


def most_frequent(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Most frequent non-null value per key, the alphabetically first on a tie.

    Counts first, so a hot key reaches the second grouping as one row per distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.v").alias(out))


def purchase_gap(sales: DataFrame) -> DataFrame:
    """Mean days between successive purchase days; the sum of gaps is last day minus first day."""
    day = F.to_date("invoice_date")
    spans = sales.groupBy("customer_id").agg(
        F.min(day).alias("_a"), F.max(day).alias("_b"), F.count_distinct(day).alias("_n")
    )
    return spans.select("customer_id", mean_gap(F.col("_a"), F.col("_b"), F.col("_n")).alias("avg_days_between_purchases"))


def mean_gap(first: Column, last: Column, days: Column) -> Column:
    return F.when(days < 2, F.lit(0.0)).otherwise(ratio(F.datediff(last, first), days - 1))


def purchase_gaps(sales: DataFrame) -> DataFrame:
    """Every gap between successive purchase days: (customer_id, purchase_day, gap_days)."""
    days = sales.select("customer_id", F.to_date("invoice_date").alias("purchase_day")).distinct()
    previous = F.lag("purchase_day").over(Window.partitionBy("customer_id").orderBy("purchase_day"))
    return days.withColumn("gap_days", F.datediff("purchase_day", previous).cast("long"))


def return_features(returns: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Return lines and returned quantity per customer, optionally only for known customers."""
    known = returns.where(F.col("customer_id").isNotNull())
    if customers is not None:
        known = known.join(customers.select("customer_id"), "customer_id", "left_semi")
    return known.groupBy("customer_id").agg(
        F.count("invoice_id").alias("total_returns"),
        F.sum(F.abs("quantity")).alias("return_quantity_abs"),
        F.lit(1).alias("has_returned"),
    )


def customer_base(sales: DataFrame, windows: Mapping[str, Column] | None = None) -> DataFrame:
    """All sales-based measures per customer.

    The lines are folded twice: to invoices (with their country and day), and to customer and product. Invoices are then
    grouped by the sets (customer, invoice), (customer, country) and (customer, day), and the small results are folded
    per customer and invoice day, and per customer. Every grouping combines before its shuffle, so a customer with a
    third of all lines is no bottleneck.

    ``windows`` maps a column prefix to a condition on the lines: the measures are computed once more
    over the lines that meet it, in the same passes (a customer without such lines has 0 invoices there).
    """
    windows = {"": F.lit(True), **(windows or {})}
    lines = sales.withColumn("_day", F.to_date("invoice_date"))
    sets = ["invoice_id", "country", "_day"]
    sums, again = [F.max("invoice_date").alias("_last_line")], [F.max("_last_line").alias("_last_line")]
    for p, inside in windows.items():
        sums += [
            F.min(F.when(inside, F.col("invoice_date"))).alias(f"_{p}date"),
            F.sum(F.when(inside, F.col("revenue").cast(MONEY))).alias(f"_{p}revenue"),
            F.sum(F.when(inside, F.col("quantity"))).alias(f"_{p}quantity"),
            F.count(F.when(inside, 1)).alias(f"_{p}lines"),
        ]
        again += [F.min(f"_{p}date").alias(f"_{p}date"), *[F.sum(f"_{p}{c}").alias(f"_{p}{c}") for c in ("revenue", "quantity", "lines")]]
    invoices = lines.groupBy("customer_id", *sets).agg(*sums)
    grouped = invoices.groupingSets([["customer_id", s] for s in sets], "customer_id", *sets).agg(
        *[F.grouping(s).alias(f"_not_{s}") for s in sets], *again
    )
    pairs = lines.groupBy("customer_id", "stock_code").agg(*[F.max(F.when(inside, 1)).alias(f"_{p}seen") for p, inside in windows.items()])
    bought = pairs.where(F.col("stock_code").isNotNull()).groupBy(F.col("customer_id").alias("_buyer")).agg(
        *[F.count(f"_{p}seen").alias(f"{p}unique_products") for p in windows]
    )

    def row_of(s: str) -> Column:
        return (F.col(f"_not_{s}") == 0) & F.col(s).isNotNull()

    # measure -> (value of a grouped row, how rows fold)
    measures = {"last_line_date": (F.when(row_of("invoice_id"), F.col("_last_line")), F.max)}
    for p in windows:
        seen = F.col(f"_{p}lines") > 0

        def of(s: str, value: Column, seen: Column = seen) -> Column:
            return F.when(row_of(s) & seen, value)

        country = F.struct((-F.col(f"_{p}lines")).alias("n"), F.col("country").alias("v"))
        measures |= {
            f"{p}first_purchase_date": (of("invoice_id", F.col(f"_{p}date")), F.min),
            f"{p}last_purchase_date": (of("invoice_id", F.col(f"_{p}date")), F.max),
            f"{p}total_invoices": (of("invoice_id", F.lit(1)), F.sum),
            f"{p}total_line_items": (of("invoice_id", F.col(f"_{p}lines")), F.sum),
            f"{p}total_quantity": (of("invoice_id", F.col(f"_{p}quantity")), F.sum),
            f"{p}total_revenue": (of("invoice_id", F.col(f"_{p}revenue")), F.sum),
            f"{p}max_invoice_value": (of("invoice_id", F.col(f"_{p}revenue")), F.max),
            f"{p}min_invoice_value": (of("invoice_id", F.col(f"_{p}revenue")), F.min),
            f"_{p}first_day": (of("_day", F.col("_day")), F.min),
            f"_{p}last_day": (of("_day", F.col("_day")), F.max),
            f"_{p}days": (of("_day", F.lit(1)), F.sum),
            f"_{p}country": (of("country", country), F.min),
        }
    invoice_day = F.to_date(F.when(row_of("invoice_id"), F.col("_date"))).alias("_invoice_day")
    per_day = grouped.groupBy("customer_id", invoice_day).agg(*[fold(v).alias(n) for n, (v, fold) in measures.items()])
    # an invoice day counts for a window when one of its invoices has lines there
    days = [
        F.count(F.when(F.col("_invoice_day").isNotNull() & (F.col(f"{p}total_invoices") > 0), 1)).alias(
            f"{p}unique_purchase_days"
        )
        for p in windows
    ]
    folded = per_day.groupBy("customer_id").agg(*[fold(n).alias(n) for n, (_, fold) in measures.items()], *days)
    folded = folded.join(bought, F.col("customer_id").eqNullSafe(F.col("_buyer")), "left")
    out = [F.col("customer_id"), F.col("last_line_date")]
    for p in windows:
        counts = ["total_invoices", "total_line_items", "total_quantity", "unique_products", "unique_purchase_days"]
        money = ["total_revenue", "max_invoice_value", "min_invoice_value"]
        gap = mean_gap(F.col(f"_{p}first_day"), F.col(f"_{p}last_day"), F.coalesce(f"_{p}days", F.lit(0)))
        out += [F.col(f"{p}first_purchase_date"), F.col(f"{p}last_purchase_date")]
        out += [F.coalesce(p + c, F.lit(0)).cast("long").alias(p + c) for c in counts]
        out += [F.col(p + c).cast("double").alias(p + c) for c in money]
        out += [gap.alias(f"{p}avg_days_between_purchases"), F.col(f"_{p}country.v").alias(f"{p}country_mode")]
    return folded.select(*out)


def ratio_features(prefix: str = "", tenure: str = "customer_tenure_days") -> dict[str, Column]:
    """Per-invoice, per-line, per-unit and per-month ratios; a month count below one counts as one."""
    c = lambda name: F.col(prefix + name)
    months = F.greatest(F.col(tenure) / F.lit(30.0), F.lit(1.0))
    return {
        f"{prefix}purchase_frequency_per_month": c("total_invoices") / months,
        f"{prefix}average_invoice_value": ratio(c("total_revenue"), c("total_invoices")),
        f"{prefix}average_line_revenue": ratio(c("total_revenue"), c("total_line_items")),
        f"{prefix}average_unit_price": ratio(c("total_revenue"), c("total_quantity")),
        f"{prefix}quantity_per_invoice": ratio(c("total_quantity"), c("total_invoices")),
        f"{prefix}products_per_invoice": ratio(c("unique_products"), c("total_invoices")),
    }


def customer_features(base: DataFrame, returns: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """The 27-column feature table from ``customer_base`` rows and return lines."""
    if snapshot is None:
        snapshot = base.agg(F.max("last_line_date") + F.expr("INTERVAL 1 DAY")).scalar()
    tenure = elapsed_days(F.col("first_purchase_date"), F.col("last_purchase_date"))
    timed = base.withColumns(
        {
            "customer_tenure_days": tenure,
            "recency_days": elapsed_days(F.col("last_purchase_date"), snapshot),
            "active_purchase_span_days": tenure,
        }
    )
    joined = timed.join(return_features(returns), "customer_id", "left")
    filled = joined.fillna({"total_returns": 0, "return_quantity_abs": 0, "has_returned": 0})
    return (
        filled.withColumn("return_rate", ratio(F.col("total_returns"), F.col("total_invoices")))
        .withColumn("is_repeat_buyer", flag(F.col("total_invoices") > 1))
        .withColumns(ratio_features())
        .select(*FEATURE_COLUMNS)
    )
