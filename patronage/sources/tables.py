"""The star-schema tables seen as transactions, returns, raw lines and complaints."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patronage.functions.rules import first_match

ORDER_COLUMNS = {"customer_id", "invoice_date", "invoice_year", "invoice_month", "invoice_yearmonth", "invoice_date_only"}


_scans: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A scan, its schema read once per application."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _scans:
        _scans[key] = spark.read.parquet(path)
    return _scans[key]


def date_parts(date: str) -> dict[str, Column]:
    return {
        "invoice_year": F.year(date),
        "invoice_month": F.month(date),
        "invoice_yearmonth": F.date_format(date, "yyyy-MM"),
        "invoice_date_only": F.date_format(date, "yyyy-MM-dd"),
    }


def places(spark: SparkSession, folder: str) -> DataFrame:
    """(supplier_id, country)."""
    nations = table(spark, folder, "nation")
    found = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return found.select(F.col("s_suppkey").alias("supplier_id"), F.col("n_name").alias("country"))


def products(spark: SparkSession, folder: str) -> DataFrame:
    """(stock_code, description)."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("stock_code"), F.col("p_name").alias("description"))


def _lines(spark: SparkSession, folder: str, wanted: set[str], condition: Column) -> DataFrame:
    """Order lines that meet ``condition`` with only the joins the wanted columns need.

    Nations meet suppliers before the lines do, and orders come last: the result is partitioned by
    order, so an invoice roll-up needs no further shuffle. No side is hinted; small ones are broadcast
    by their size, large ones are sorted and merged.
    """
    out = table(spark, folder, "lineitem").where(condition)
    if "description" in wanted:
        out = out.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "country" in wanted:
        out = out.join(places(spark, folder), F.col("l_suppkey") == F.col("supplier_id"))
    if wanted & ORDER_COLUMNS:
        out = out.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return out


def _project(lines: DataFrame, wanted: Iterable[str]) -> DataFrame:
    expressions = {
        "invoice_id": F.col("l_orderkey"),
        "stock_code": F.col("l_partkey"),
        "description": F.col("p_name") if "p_name" in lines.columns else None,
        "quantity": F.col("l_quantity").cast("long"),
        "revenue": F.col("l_extendedprice"),
        "unit_price": F.col("l_extendedprice") / F.col("l_quantity"),
        "country": F.col("country") if "country" in lines.columns else None,
        "supplier_id": F.col("l_suppkey"),
    }
    if "o_orderdate" in lines.columns:
        expressions |= {"customer_id": F.col("o_custkey"), "invoice_date": F.col("o_orderdate")}
        expressions |= date_parts("o_orderdate")
    return lines.select(*[expressions[c].alias(c) for c in wanted])


def sales(spark: SparkSession, folder: str, columns: Iterable[str]) -> DataFrame:
    """Clean sales lines: every line that was not returned."""
    columns = list(columns)
    return _project(_lines(spark, folder, set(columns), F.col("l_returnflag") != "R"), columns)


def returns(spark: SparkSession, folder: str, columns: Iterable[str]) -> DataFrame:
    """Returned lines; quantities are negative, as on a credit note."""
    columns = list(columns)
    out = _project(_lines(spark, folder, set(columns), F.col("l_returnflag") == "R"), columns)
    return out.withColumn("quantity", -F.col("quantity")) if "quantity" in columns else out


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Uncleaned lines under their raw names, with the faults the cleaning step is for.

    Faults follow from the data itself: guest orders have no customer, giveaways no price, one part
    size no description, returned lines a "C" invoice and a negative quantity, and lines that were
    exported twice appear twice.
    """
    lines = _lines(spark, folder, {"customer_id", "description", "country"}, F.lit(True))
    returned = F.col("l_returnflag") == "R"
    guest = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    giveaway = (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.0)
    twice = (F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "F") & (F.col("l_tax") == 0.0)
    shown = lines.select(
        F.concat(F.when(returned, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("Invoice"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.when(F.col("p_size") != 1, F.col("p_name")).alias("Description"),
        (F.col("l_quantity") * F.when(returned, -1).otherwise(1)).cast("long").alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.when(giveaway, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"),
        F.when(~guest, F.col("o_custkey")).cast("double").alias("Customer ID"),
        F.col("country").alias("Country"),
        F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return shown.drop("_copy")


def length_topic(chars: Column) -> Column:
    """Topic number 1..8 by length octave; null (no topic) beyond the last octave."""
    bounds = [(200 * 2**i, i + 1) for i in range(8)]
    return first_match([(chars < bound, topic) for bound, topic in bounds])


RESPONSE_COLUMNS = ("submitted_via", "timely_response")


def with_responses(complaints: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Add channel and timeliness by complaint id. Join narrow rows: texts should be dropped before."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("complaint_id"),
        F.when(F.col("toxic") == 1, "Phone").when(F.col("toxic") == 0, "Web").alias("submitted_via"),
        F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").alias("timely_response"),
    )
    return complaints.join(labels, "complaint_id", "left")


def complaints(spark: SparkSession, folder: str, responses: bool = True) -> DataFrame:
    """Documents as complaints: language is the product, source the issue, labels the response."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("complaint_id"),
        F.col("lang").alias("product"),
        F.col("source").alias("issue"),
        F.col("text").alias("complaint_what_happened"),
        length_topic(F.col("n_chars")).alias("dominant_topic"),
    )
    return with_responses(docs, spark, folder) if responses else docs


def dealt(texts: DataFrame) -> DataFrame:
    """The same rows dealt out by their hash, before work that takes long for each text.

    A file that holds one large row group is read by one task, which would do all that work alone.
    """
    return texts.repartition(F.xxhash64(*texts.columns))
