"""Exploratory reports over transaction lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions.numeric import MONEY, exact_avg, finite, money_sum, non_blank, pct, ratio, round_half_up
from patronage.operators.ranking import exact_quantiles
from patronage.session import pin


def line_sizes(
    lines: DataFrame, invoice: str, customer: str, product: str, country: str, sums: Mapping[str, tuple[str, Column]],
    products: DataFrame | None = None,
) -> DataFrame:
    """One row with the distinct invoices, customers, products and countries of the lines, and other ``sums`` over them.

    Lines are folded to (invoice, customer, country) before three of the distinct counts, and to products for the fourth,
    so that no line is sent once for each count. ``sums`` gives each measure its kind (count, sum, min or max) and its
    aggregate of the lines. ``products`` may give the lines' products without the joins that the other columns need.
    """
    folds = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    folded = lines.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in ((invoice, "_invoice"), (customer, "_customer"), (country, "_country"))]).agg(
        *[measure.alias(name) for name, (_, measure) in sums.items()]
    )
    products = (lines if products is None else products).groupBy(F.col(f"`{product}`").alias("_p")).agg(F.count(F.lit(1)).alias("_k")).agg(F.count("_p"))
    row = folded.agg(
        *[folds[kind](name).alias(name) for name, (kind, _) in sums.items()],
        F.count_distinct("_customer").alias("unique_customers"), F.count_distinct("_invoice").alias("unique_invoices"),
        F.count_distinct("_country").alias("unique_countries"),
    )
    return row.withColumn("unique_products", products.scalar())


def dataset_overview(sales: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Rows, distinct keys and date range; ``products`` as in ``line_sizes``."""
    found = line_sizes(sales, "invoice_id", "customer_id", "stock_code", "country", {
        "total_rows": ("count", F.count(F.lit(1))), "date_min": ("min", F.min("invoice_date")), "date_max": ("max", F.max("invoice_date")),
    }, products)
    return found.select(
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"), "unique_customers", "unique_invoices", "unique_products", "unique_countries",
        "date_min", "date_max",
    )


def distribution_summary(df: DataFrame, *columns: str) -> DataFrame:
    """n, min, max, exact median and mean per measure."""
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), finite(c).alias("value")) for c in columns])
    long = df.select(F.explode(entries).alias("e")).select("e.*").where(F.col("value").isNotNull())
    means = long.groupBy("metric").agg(ratio(F.sum(F.col("value").cast("decimal(24,4)")), F.count("value")).alias("mean"))
    medians = exact_quantiles(df, columns, [0.5])
    return medians.join(means, "metric").select("metric", "n", "min", "max", F.col("q")[0].alias("median"), "mean")


def revenue_metrics(sales: DataFrame) -> DataFrame:
    """Totals, mean and median over the invoices; the lines are read once, to roll them up."""
    invoices = pin(sales.groupBy("invoice_id").agg(F.sum(F.col("revenue").cast(MONEY)).alias("_revenue"), F.sum("quantity").alias("_quantity")))
    orders = exact_quantiles(invoices, {"order_value": F.col("_revenue").cast("double")}, [0.5])
    totals = invoices.agg(F.sum("_revenue").cast("double").alias("total_revenue"), F.sum("_quantity").alias("total_quantity"))
    return (
        totals.withColumn("total_invoices", orders.select("n").scalar())
        .withColumn("median_order_value", orders.select(F.col("q")[0]).scalar())
        .withColumn("avg_order_value", ratio(F.col("total_revenue"), F.col("total_invoices")))
    )


def revenue_by(sales: DataFrame, *keys: str) -> DataFrame:
    return sales.groupBy(*keys).agg(money_sum("revenue").alias("total_revenue"))


def revenue_by_name(sales: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """Revenue per ``name`` of ``names`` (key, name): lines are folded per key before they meet the names."""
    per_key = sales.groupBy(key).agg(F.sum(F.col("revenue").cast(MONEY)).alias("_revenue"))
    return per_key.join(names, key).groupBy(name).agg(F.sum("_revenue").cast("double").alias("total_revenue"))


def top_by(df: DataFrame, measure: str, k: int, *tie: str) -> DataFrame:
    """The k largest rows; ties in key order."""
    return df.orderBy(F.desc(measure), *tie).limit(k)


def distinct_by(sales: DataFrame, key: str, value: str, out: str) -> DataFrame:
    return sales.groupBy(key).agg(F.count_distinct(value).alias(out))


def _customer_folds(sales: DataFrame, *keys: str) -> DataFrame:
    """Revenue, quantity and distinct invoices per ``keys`` and customer. An invoice belongs to one customer.

    Lines are folded to invoices first, which needs no shuffle where they are partitioned by order.
    """
    sums = [F.sum(F.col("revenue").cast(MONEY)).alias("_revenue"), F.sum("quantity").alias("_quantity")]
    invoices = sales.groupBy(*keys, "customer_id", "invoice_id").agg(*sums)
    return invoices.groupBy(*keys, "customer_id").agg(
        F.sum("_revenue").alias("_revenue"), F.sum("_quantity").alias("_quantity"), F.count("invoice_id").alias("_invoices")
    )


def monthly_report(sales: DataFrame) -> DataFrame:
    """Revenue, invoices, active customers, quantity and mean order value per month."""
    months = _customer_folds(sales, "invoice_yearmonth").groupBy(F.col("invoice_yearmonth").alias("invoice_month")).agg(
        F.sum("_revenue").cast("double").alias("_revenue"),
        F.sum("_invoices").alias("total_invoices"),
        F.count("customer_id").alias("active_customers"),
        F.sum("_quantity").alias("total_quantity"),
    )
    return months.select(
        "invoice_month",
        round_half_up(F.col("_revenue"), 2).alias("total_revenue"),
        "total_invoices",
        "active_customers",
        "total_quantity",
        round_half_up(ratio(F.col("_revenue"), F.col("total_invoices")), 2).alias("avg_order_value"),
    ).orderBy("invoice_month")


def product_report(sales: DataFrame, k: int = 50, names: DataFrame | None = None, sold: DataFrame | None = None) -> DataFrame:
    """The k products with the most revenue; lines without a description are left out.

    Descriptions are a column of the lines, or come from ``names`` (stock_code, description), which then meets one row per
    product. Invoices and customers are counted over the lines of the k products only; ``sold`` may give all lines without
    the joins that these need.
    """
    keys = ["stock_code"] if names is not None else ["stock_code", "description"]
    totals = (sales if sold is None else sold).groupBy(*keys).agg(
        round_half_up(money_sum("revenue"), 2).alias("total_revenue"),
        F.sum("quantity").alias("total_quantity"),
        round_half_up(exact_avg("unit_price", "decimal(24,8)"), 4).alias("avg_unit_price"),
    )
    if names is not None:
        totals = totals.join(names, "stock_code")
    top = pin(top_by(totals.where(non_blank("description")), "total_revenue", k, "stock_code", "description"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    few = sales.alias("l").join(F.broadcast(top.select(*keys).alias("t")), same, "left_semi")  # k rows
    counts = few.groupBy(*keys).agg(
        F.count_distinct("invoice_id").alias("total_invoices"), F.count_distinct("customer_id").alias("unique_customers")
    )
    joined = top.alias("t").join(counts.alias("l"), same)
    return joined.select(
        "t.stock_code", "t.description", "total_revenue", "total_quantity", "total_invoices", "unique_customers", "avg_unit_price"
    ).orderBy(F.desc("total_revenue"), "stock_code", "description")


def order_value_trend(sales: DataFrame) -> DataFrame:
    """Mean of the invoice values per month."""
    values = sales.groupBy("invoice_yearmonth", "invoice_id").agg(F.sum(F.col("revenue").cast(MONEY)).alias("_v"))
    return values.groupBy("invoice_yearmonth").agg(ratio(F.sum("_v"), F.count(F.lit(1))).alias("avg_order_value"))


def peak_and_low(df: DataFrame, name: str, measure: str) -> DataFrame:
    """The groups with the largest and the smallest measure, the lowest name on a tie."""
    best = F.min(F.struct((-F.col(measure)).alias("m"), F.col(name).alias("v")))
    worst = F.min(F.struct(F.col(measure).alias("m"), F.col(name).alias("v")))
    return df.agg(best.alias("b"), worst.alias("w")).select(
        F.col("b.v").alias(f"peak_{name}"),
        (-F.col("b.m")).alias(f"peak_{measure}"),
        F.col("w.v").alias(f"low_{name}"),
        F.col("w.m").alias(f"low_{measure}"),
    )


def orders_per_customer(sales: DataFrame) -> DataFrame:
    invoices = sales.groupBy("customer_id", "invoice_id").agg(F.lit(1))
    return invoices.groupBy("customer_id").agg(F.count("invoice_id").alias("num_orders"))


def repeat_behaviour(sales: DataFrame) -> DataFrame:
    """One-time against repeat buyers: customers, shares and revenue."""
    invoices = sales.groupBy("customer_id", "invoice_id").agg(F.sum(F.col("revenue").cast(MONEY)).alias("_revenue"))
    customers = invoices.groupBy("customer_id").agg(F.count("invoice_id").alias("_orders"), F.sum("_revenue").alias("_revenue"))
    repeat = F.col("_orders") > 1

    def both(condition: Column, name: str) -> Sequence[Column]:
        return [
            F.count(F.when(condition, 1)).alias(f"{name}_customers"),
            F.coalesce(F.sum(F.when(condition, F.col("_revenue"))).cast("double"), F.lit(0.0)).alias(f"{name}_revenue"),
        ]

    totals = customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("_revenue").cast("double").alias("total_revenue"),
        *both(repeat, "repeat"),
        *both(~repeat, "one_time"),
    )
    for name in ("repeat", "one_time"):
        totals = totals.withColumn(
            f"{name}_customer_pct", round_half_up(pct(F.col(f"{name}_customers"), F.col("total_customers")), 4)
        ).withColumn(f"{name}_revenue_pct", round_half_up(pct(F.col(f"{name}_revenue"), F.col("total_revenue")), 4))
    return totals


def revenue_of_group(sales: DataFrame, members: DataFrame, key: str = "customer_id") -> DataFrame:
    """Revenue of the lines whose key is in ``members`` (a semi-join).

    The lines are summed per key first, so the join moves one row per key however hot it is.
    """
    per_key = sales.groupBy(key).agg(F.sum(F.col("revenue").cast(MONEY)).alias("_revenue"))
    kept = per_key.join(members.select(key), key, "left_semi")
    return kept.agg(F.sum("_revenue").cast("double").alias("revenue"))
