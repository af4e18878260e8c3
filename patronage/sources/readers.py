"""Reading tables, CSV parts and JSON envelopes with a checked set of columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("Invoice", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.LongType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("Price", T.DoubleType()),
        T.StructField("Customer ID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)

HIT_FIELDS = "complaint_id string, product string, issue string, submitted_via string, complaint_what_happened string"


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail early, from the schema alone, when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def keep_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Project the wanted columns that exist, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate name the table has."""
    return next((c for c in candidates if c in df.columns), None)


def read_table(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    return require_columns(spark.read.parquet(path), required)


def read_csv(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header; types come from ``schema``, else everything is text.

    Files are split over tasks. Quoted text with line breaks needs ``multi_line``, which reads each file in one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(paths)


def read_json(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One record per line, so that files are split over tasks."""
    return spark.read.schema(schema).json(paths)


def read_raw_parts(spark: SparkSession, paths: Sequence[str], fmt: str = "csv") -> DataFrame:
    """All parts of the raw transactions under one another."""
    if fmt == "csv":
        return read_csv(spark, list(paths), RAW_SCHEMA)
    return reduce(lambda a, b: a.unionByName(b), [spark.read.format(fmt).load(p) for p in paths])


def parse_hits(df: DataFrame, json_column: str, fields: str = HIT_FIELDS) -> DataFrame:
    """Records of a search reply: ``{"hits": [record or {"_source": record}, ...]}`` held as text."""
    record = T._parse_datatype_string(f"struct<{fields}>") if isinstance(fields, str) else fields
    hit = T.StructType([T.StructField("_source", record), *record.fields])
    envelope = T.StructType([T.StructField("hits", T.ArrayType(hit))])
    hits = df.select(F.explode(F.from_json(F.col(json_column), envelope)["hits"]).alias("h"))
    return hits.select(
        *[
            F.when(F.col("h._source").isNotNull(), F.col(f"h._source.{f.name}"))
            .otherwise(F.col(f"h.{f.name}"))
            .alias(f.name)
            for f in record.fields
        ]
    )


def read_hits(spark: SparkSession, paths: str | list[str], fields: str = HIT_FIELDS) -> DataFrame:
    """Envelope files, one JSON document per file: replies of a search, small by nature (a row holds at most 2 GB)."""
    texts = spark.read.text(paths, wholetext=True)
    return parse_hits(texts, "value", fields)
