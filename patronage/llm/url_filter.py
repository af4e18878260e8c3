"""URL rules by host suffix and path prefix, matched on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Hex digits of the short hash prefix (32 bits).
PREFIX_DIGITS = 8


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(prefix, digest, rule, verdict): one row per expression; block wins if an expression has both verdicts."""
    rows = spark.createDataFrame([(r.host + r.path, r.verdict) for r in rules], "rule string, verdict string")
    return (
        rows.groupBy("rule").agg(F.max("verdict").alias("verdict"))
        .select(F.substring(F.sha2("rule", 256), 1, PREFIX_DIGITS).alias("prefix"), F.sha2("rule", 256).alias("digest"), "rule", "verdict")
    )


def _until(text: Column, marks: str) -> Column:
    return F.regexp_extract(text, f"(?s)^([^{marks}]*)", 1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(_until(rest, "/?#"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, _until(F.substring(rest, F.length(host) + 1, F.length(rest)), "?#")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of (page_id, url, ...).

    A rule fits its host and all its subdomains where the path starts with the rule's; the longest host and path
    wins. A url that no rule fits, a null url and one without ``://`` get a null rule and the verdict ``default``.
    Each distinct (host, path) is expanded once, so repeated urls and a hot host cost no more than their distinct
    paths, and repeated rows give repeated rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths])) if lengths else F.array(F.lit(""))
    expressions = (
        rows.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("start"))
        .withColumn("digest", F.sha2(F.concat("suffix", "start"), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    listed = rules_table(spark, rules).withColumnRenamed("digest", "full")
    found = (
        expressions.join(listed, "prefix")
        .where(F.col("digest") == F.col("full"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("suffix").alias("h"), "rule", "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
