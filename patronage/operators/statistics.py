"""Descriptive statistics, group tests, rank correlation and regressions on the customer table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions.distributions import chi_square_p_value, t_critical, t_p_value
from patronage.functions.fixed_values import (
    CHURN_REGRESSORS, CORRELATED_METRICS, DESCRIBED_METRICS, EFFECT_SIZES, HEALTH_DIFFERS, HEALTH_REGRESSORS, HEALTH_SAME, LARGEST_EFFECT,
    RISK_GROUP_METRICS,
)
from patronage.functions.numeric import finite
from patronage.functions.rules import under
from patronage.operators.moments import least_squares, logistic, rank_correlations
from patronage.operators.ranking import attach_average_ranks, exact_quantiles, histogram, value_counts
from patronage.session import pin

#: Distinct values of all ranked columns that are sent to the tasks (16 bytes each).
RANKED_VALUES = 1_000_000


def long_metrics(df: DataFrame, metrics: Sequence[str], *keep: Column) -> DataFrame:
    """(metric, value) rows of the finite values of the metrics the table has."""
    present = [m for m in metrics if m in df.columns]
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), finite(m).alias("value")) for m in present])
    long = df.select(*keep, F.explode(entries).alias("e")).select("*", "e.metric", "e.value").drop("e")
    return long.where(F.col("value").isNotNull())


def describe_metrics(df: DataFrame, metrics: Sequence[str] = DESCRIBED_METRICS) -> DataFrame:
    """n, mean, median, sample std, min and max per metric; metrics with fewer than two values are left out."""
    moments = long_metrics(df, metrics).groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    present = [m for m in metrics if m in df.columns]
    medians = exact_quantiles(df, present, [0.5]).select("metric", F.col("q")[0].alias("median"))
    return moments.join(medians, "metric").where(F.col("n") >= 2)


def mean_interval(mean: Column, std: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """t interval of a mean, null for fewer than two values."""
    margin = std / F.sqrt(n.cast("double")) * t_critical((1.0 + confidence) / 2.0, F.when(n >= 2, n - 1))
    return mean - margin, mean + margin


def describe_with_interval(df: DataFrame, metrics: Sequence[str] = DESCRIBED_METRICS) -> DataFrame:
    described = describe_metrics(df, metrics)
    low, high = mean_interval(F.col("mean"), F.col("std"), F.col("n"))
    return described.withColumn("ci_95_lower", low).withColumn("ci_95_upper", high)


def two_group_moments(df: DataFrame, metrics: Sequence[str], group: Column) -> DataFrame:
    """n, mean and sample variance per metric for the rows where ``group`` is true and where it is false."""
    long = long_metrics(df, metrics, group.alias("_g")).where(F.col("_g").isNotNull())
    parts = []
    for name, condition in (("1", F.col("_g")), ("2", ~F.col("_g"))):
        value = F.when(condition, F.col("value"))
        parts += [
            F.count(value).alias(f"n{name}"), F.avg(value).alias(f"mean{name}"), F.var_samp(value).alias(f"var{name}")
        ]
    return long.groupBy("metric").agg(*parts)


def welch(moments: DataFrame) -> DataFrame:
    """Difference, Welch t, Welch-Satterthwaite degrees of freedom, Cohen's d and its size.

    A group of fewer than two values has no variance: its statistics are null.
    """
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    s1, s2 = F.col("var1") / n1, F.col("var2") / n2
    difference = F.col("mean1") - F.col("mean2")
    zero = F.lit(0.0)
    pooled = F.sqrt(((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / F.nullif(n1 + n2 - 2, zero))
    return moments.withColumns(
        {
            "difference": difference,
            "t_statistic": difference / F.nullif(F.sqrt(s1 + s2), zero),
            "degrees_of_freedom": (s1 + s2) * (s1 + s2) / F.nullif(s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1), zero),
            "cohens_d": difference / F.nullif(pooled, zero),
        }
    ).withColumn("effect_interpretation", under(F.abs("cohens_d"), EFFECT_SIZES, LARGEST_EFFECT))


def with_p_value(tests: DataFrame, level: float = 0.05) -> DataFrame:
    tested = tests.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("degrees_of_freedom")))
    return tested.withColumn("statistically_significant", F.col("p_value") < level)


def returns_group() -> Column:
    return F.when(F.col("has_returned") == 1, True).when(F.col("has_returned") == 0, False)


def risk_group() -> Column:
    tier = F.col("churn_risk_tier")
    return F.when(tier.isin("High Risk", "Critical Risk"), True).when(tier.isin("Low Risk", "Medium Risk"), False)


def returns_moments(c360: DataFrame) -> DataFrame:
    return welch(two_group_moments(c360, ["customer_health_score"], returns_group()))


def returns_vs_health(c360: DataFrame) -> DataFrame:
    """Does health differ between customers with and without returns?"""
    tested = with_p_value(returns_moments(c360))
    return tested.withColumn("conclusion", F.when(F.col("statistically_significant"), HEALTH_DIFFERS).otherwise(HEALTH_SAME))


def risk_group_moments(c360: DataFrame) -> DataFrame:
    moments = two_group_moments(c360, RISK_GROUP_METRICS, risk_group())
    return welch(moments.where((F.col("n1") >= 2) & (F.col("n2") >= 2)))


def risk_group_tests(c360: DataFrame) -> DataFrame:
    """High and critical against low and medium risk, metric by metric."""
    return with_p_value(risk_group_moments(c360))


def rank_tables(counts: DataFrame, names: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each column its values in order and their average ranks less the mean rank, from (metric, value, cnt) rows."""
    found = counts.orderBy("metric", "value").toArrow()
    metric, value, cnt = (found.column(c).to_numpy() for c in ("metric", "value", "cnt"))
    tables = []
    for name in names:
        own = metric == name
        n = cnt[own]
        upto = np.cumsum(n)
        tables.append((value[own], upto - n + (n + 1) / 2.0 - (n.sum() + 1) / 2.0))
    return tables


def spearman(df: DataFrame, key: str, metrics: Sequence[str] = CORRELATED_METRICS) -> DataFrame:
    """Pairwise-complete rank correlations as (metric_a, metric_b, correlation).

    Columns without nulls are ranked once over all rows. A column with nulls also needs every other
    column ranked over its own non-null rows. All rankings share one pass over one long table of counts. Up to
    ``RANKED_VALUES`` distinct values, the ranks go to the tasks, which multiply them in one pass over the rows; beyond,
    ranks come from range partitions and join the rows.
    """
    metrics = [m for m in metrics if m in df.columns]
    values = {m: finite(m) for m in metrics}
    null_row = df.agg(*[F.count(F.when(values[m].isNull(), 1)).alias(m) for m in metrics]).first()
    holed = [m for m in metrics if null_row[m] > 0]

    def ranked_name(m: str, other: str) -> str:
        """The column that holds the ranks of m over the rows where both are present."""
        mask = sorted({c for c in (m, other) if c in holed})
        return "__".join([m, *mask])

    pairs = list(combinations_with_replacement(metrics, 2))
    needed: dict[str, Column] = {}
    for a, b in pairs:
        both = values[a].isNotNull() & values[b].isNotNull()
        for m, other in ((a, b), (b, a)):
            needed[ranked_name(m, other)] = F.when(both, values[m]) if {a, b} & set(holed) else values[m]
    names = sorted(needed)
    masked = df.select(key, *[(finite(needed[c]) + F.lit(0.0)).alias(c) for c in names])
    counts = pin(value_counts(masked, names))
    if counts.limit(RANKED_VALUES + 1).count() <= RANKED_VALUES:
        found = rank_correlations(masked, rank_tables(counts, names), names)
        place = {c: i for i, c in enumerate(names)}
        entries = [
            (x, y, float(v) if (v := found[place[ranked_name(x, y)], place[ranked_name(y, x)]]) == v else None)
            for a, b in pairs for x, y in {(a, b), (b, a)}
        ]
        return df.sparkSession.createDataFrame(entries, "metric_a string, metric_b string, correlation double")
    ranks = attach_average_ranks(df.select(key, *metrics), key, histogram(df, needed), needed, percent=False)
    row = ranks.agg(
        *[
            F.corr(f"{ranked_name(a, b)}_rank", f"{ranked_name(b, a)}_rank").alias(f"c{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    entries = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            entries.append(
                F.struct(F.lit(x).alias("metric_a"), F.lit(y).alias("metric_b"), F.col(f"c{i}").alias("correlation"))
            )
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _coefficient_rows(df: DataFrame, names: Sequence[str], columns: Mapping[str, Sequence[float]]) -> DataFrame:
    rows = [tuple([name, *[None if np.isnan(v[i]) else float(v[i]) for v in columns.values()]]) for i, name in enumerate(names)]
    schema = ", ".join(["feature string", *[f"{c} double" for c in columns]])
    return df.sparkSession.createDataFrame(rows, schema)


def health_regression(c360: DataFrame, target: str = "customer_health_score", features: Sequence[str] = HEALTH_REGRESSORS) -> DataFrame:
    """Least squares with p-values and R squared; the intercept is named const. Empty without more rows than weights."""
    fit = least_squares(c360, target, features)
    names = ["const", *features] if fit else []
    columns = {"coefficient": fit.weights, "std_error": fit.errors} if fit else {"coefficient": [], "std_error": []}
    rows = _coefficient_rows(c360, names, columns)
    t = F.col("coefficient") / F.nullif(F.col("std_error"), F.lit(0.0))
    tested = rows.withColumn("p_value", t_p_value(t, F.lit(float(fit.dof if fit else 1))))
    return tested.withColumn("significant_at_5pct", F.col("p_value") < 0.05).withColumn("r_squared", F.lit(fit.r_squared if fit else None).cast("double"))


def churn_regression(c360: DataFrame, target: str = "actual_churned", features: Sequence[str] = CHURN_REGRESSORS) -> DataFrame:
    """Logistic regression on the actual outcome: odds ratios with 95 % interval and p-values.

    Where the features separate the classes there are no finite odds: ``settled`` is false and the numbers are null.
    """
    fit = logistic(c360, target, features)
    names = ["const", *features] if fit else []
    columns = {"coefficient": fit.weights, "std_error": fit.errors} if fit else {"coefficient": [], "std_error": []}
    out = _coefficient_rows(c360, names, columns)
    b, se = F.col("coefficient"), F.col("std_error")
    z = F.lit(1.959963984540054)
    ratio = b / F.nullif(se, F.lit(0.0))
    return out.withColumns(
        {
            "p_value": chi_square_p_value(ratio * ratio, F.lit(1)),
            "odds_ratio": F.exp(b),
            "ci_lower": F.exp(b - z * se),
            "ci_upper": F.exp(b + z * se),
        }
    ).withColumn("significant_at_5pct", F.col("p_value") < 0.05).withColumn("settled", F.lit(bool(fit and fit.settled)))
