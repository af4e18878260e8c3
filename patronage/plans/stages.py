"""Stage tables: stored once per application and read by every later step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patronage.session import pin

_stages: dict[tuple, DataFrame] = {}


def stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table ``name`` over the tables in ``folder``, built on first use."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stages:
        _stages[key] = pin(build())
    return _stages[key]
