"""Parquet, CSV and JSON sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV part with a header."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_export(df: DataFrame, path: str) -> None:
    """A customer-sized export: CSV parts written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.repartition(1).write.mode("overwrite").json(path)


def write_reports(reports: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Write each named report under ``folder``."""
    for name, df in reports.items():
        write_report(df, f"{folder}/{name}")
    return list(reports)
