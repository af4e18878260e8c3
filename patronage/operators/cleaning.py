"""From raw lines to clean transactions and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.fixed_values import CLEAN_COLUMNS, RAW_COLUMN_NAMES
from patronage.sources.readers import require_columns


def standardize(raw: DataFrame) -> DataFrame:
    require_columns(raw, RAW_COLUMN_NAMES)
    return raw.withColumnsRenamed(RAW_COLUMN_NAMES)


def is_cancellation(invoice: str | Column = "invoice_id") -> Column:
    c = F.col(invoice) if isinstance(invoice, str) else invoice
    return F.coalesce(c.cast("string").startswith("C"), F.lit(False))


def split_returns(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sales, returns) by the cancellation prefix."""
    return lines.where(~is_cancellation()), lines.where(is_cancellation())


def drop_conditions() -> list[tuple[str, Column]]:
    """Reasons to drop a sales line, in order; the first that applies counts."""
    return [
        ("missing_customer", F.col("customer_id").isNull()),
        ("bad_quantity", ~F.coalesce(F.col("quantity") > 0, F.lit(False))),
        ("bad_price", ~F.coalesce(F.col("unit_price") > 0, F.lit(False))),
        ("missing_description", F.col("description").isNull()),
    ]


def add_derived(lines: DataFrame) -> DataFrame:
    """Final types, line revenue and calendar columns, in contract order."""
    date = F.col("invoice_date").cast("timestamp_ntz")
    return lines.withColumns(
        {
            "customer_id": F.col("customer_id").cast("long"),
            "invoice_id": F.col("invoice_id").cast("string"),
            "stock_code": F.col("stock_code").cast("string"),
            "invoice_date": date,
            "revenue": F.col("quantity") * F.col("unit_price"),
            "invoice_year": F.year(date),
            "invoice_month": F.month(date),
            "invoice_yearmonth": F.date_format(date, "yyyy-MM"),
            "invoice_date_only": F.date_format(date, "yyyy-MM-dd"),
        }
    ).select(*CLEAN_COLUMNS)


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Distinct sales lines that pass every cleaning step, with derived columns."""
    sales, _ = split_returns(standardize(raw))
    for _, condition in drop_conditions():
        sales = sales.where(~condition)
    return add_derived(sales.dropDuplicates())


def returned_lines(raw: DataFrame) -> DataFrame:
    """Distinct cancellation lines under the clean names."""
    return split_returns(standardize(raw))[1].dropDuplicates()


def cleaning_steps(raw: DataFrame) -> DataFrame:
    """Rows dropped by each step and rows left, from one grouping over the raw lines: (step, rows)."""
    lines = standardize(raw)
    distinct = lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("_copies"))
    reason = F.when(is_cancellation(), F.lit("returns"))
    for name, condition in drop_conditions():
        reason = reason.when(condition, F.lit(name))
    judged = distinct.select("_copies", reason.otherwise("clean").alias("_reason"))
    names = ["returns", *[n for n, _ in drop_conditions()], "clean"]
    totals = judged.agg(
        F.sum("_copies").alias("raw"),
        F.sum(F.col("_copies") - 1).alias("duplicates"),
        *[F.count(F.when(F.col("_reason") == n, 1)).alias(n) for n in names],
    )
    ordered = ["raw", "duplicates", *names]
    rows = F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("rows")) for n in ordered])
    return totals.select(F.explode(rows).alias("s")).select("s.*")


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank filter is applied in each task before the shuffle, so a hot key sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
