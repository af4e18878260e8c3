"""Contingency tables: chi-square, Cramer's V, residuals, Wilson intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions.distributions import chi_square_p_value
from patronage.functions.fixed_values import WILSON_Z
from patronage.functions.numeric import pct, round_half_up
from patronage.functions.rules import first_match
from patronage.session import pin


def cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, observed) of the pairs that occur; rows with a null in either column are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))


def margin(found: DataFrame, side: str, total: str) -> DataFrame:
    """(side, total) summed over the cells."""
    return found.groupBy(side).agg(F.sum("observed").alias(total))


def with_zero_cells(found: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of the values of both columns, those that do not occur with 0: a table as long as its result must be."""
    values = found.select(b).distinct().agg(F.collect_list(b)).scalar()
    full = found.select(a).distinct().select(a, F.explode(values).alias(b))
    return full.join(found, [a, b], "left").select(a, b, F.coalesce("observed", F.lit(0)).alias("observed"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Zero-filled counts (a, b, observed) over the observed values of both columns."""
    return with_zero_cells(pin(cells(df, a, b)), a, b)


def with_expected(observed: DataFrame, a: str, b: str) -> DataFrame:
    """Margins and expected counts beside each cell. ``observed`` is one row per pair of values; zero cells may be missing."""
    whole = observed.agg(F.sum("observed")).scalar()
    joined = observed.join(margin(observed, a, "row_total"), a).join(margin(observed, b, "col_total"), b).withColumn("total", whole)
    return joined.withColumn("expected", F.col("row_total").cast("double") * F.col("col_total") / F.col("total"))


def _phi_correction(chi2: Column) -> Column:
    n, r, c = F.col("n"), F.col("n_rows"), F.col("n_cols")
    return F.greatest(chi2 / n - ((c - 1) * (r - 1)).cast("double") / (n - 1), F.lit(0.0))


def chi_square(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """One row: table size, chi-square, degrees of freedom and Cramer's V.

    Only cells that occur are read: with R and C the margins, chi-square is n (sum of O^2 / (R C) - 1). The continuity
    correction applies at one degree of freedom only, and never inside V; there all four cells miss their expectation by
    the same number, which follows from chi-square and the margins.
    """
    found = pin(cells(df, a, b))
    sides = [
        margin(found, side, "t").agg(F.count(F.lit(1)).alias("k"), F.sum(F.lit(1.0) / F.col("t")).alias("inverse")) for side in (a, b)
    ]
    share = F.sum(F.col("observed").cast("double") * F.col("observed") / (F.col("row_total").cast("double") * F.col("col_total")))
    sums = with_expected(found, a, b).agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), share.alias("_share")).withColumns({
        "n_rows": sides[0].select("k").scalar(), "n_cols": sides[1].select("k").scalar(),
        "_inverse": sides[0].select("inverse").scalar() * sides[1].select("inverse").scalar(),
    })
    sums = sums.withColumns({
        "_plain": F.greatest(F.col("n") * (F.col("_share") - 1), F.lit(0.0)),
        "degrees_of_freedom": (F.col("n_rows") - 1) * (F.col("n_cols") - 1),
    })
    spread = F.col("n") * F.col("_inverse")  # sum of 1 / expected over all cells
    gap = F.sqrt(F.col("_plain") / spread)
    corrected = (gap - F.least(gap, F.lit(0.5))) * (gap - F.least(gap, F.lit(0.5))) * spread
    statistic = F.when((F.col("degrees_of_freedom") == 1) & F.lit(yates), corrected).otherwise(F.col("_plain"))
    least = F.least(F.col("n_cols") - 1, F.col("n_rows") - 1)
    v = F.when(least == 0, F.lit(0.0)).otherwise(F.sqrt(_phi_correction(F.col("_plain")) / F.nullif(least, F.lit(0))))
    return sums.select(
        "n", "n_rows", "n_cols", statistic.alias("chi_square"), "degrees_of_freedom", v.alias("cramers_v")
    )


def chi_square_test(df: DataFrame, a: str, b: str, name: str, level: float = 0.05) -> DataFrame:
    """The test row with p-value and verdict."""
    row = chi_square(df, a, b).withColumn("p_value", chi_square_p_value(F.col("chi_square"), F.col("degrees_of_freedom")))
    return row.select(
        F.lit(name).alias("analysis"), "chi_square", "degrees_of_freedom", "p_value", "cramers_v",
        (F.col("p_value") < level).alias("statistically_significant"),
    )


def residuals(df: DataFrame, a: str, b: str, zero_cells: bool = True) -> DataFrame:
    """Pearson residual per cell with strength and direction; strength is judged on the rounded value.

    Without ``zero_cells`` only pairs that occur are listed: enough for points above their expectation.
    """
    found = pin(cells(df, a, b))
    expected = with_expected(with_zero_cells(found, a, b) if zero_cells else found, a, b)
    exact = (F.col("observed") - F.col("expected")) / F.sqrt("expected")
    rounded = expected.select(
        a, b, "observed",
        round_half_up(F.col("expected"), 2).alias("expected"),
        round_half_up(exact, 4).alias("residual"),
        round_half_up(F.abs(exact), 4).alias("abs_residual"),
    )
    size, value = F.col("abs_residual"), F.col("residual")
    return rounded.withColumns(
        {
            "association_strength": first_match([(size >= 3, "Strong"), (size >= 2, "Notable")], "Normal"),
            "direction": first_match(
                [(value > 0, "Higher than expected"), (value < 0, "Lower than expected")], "Expected"
            ),
        }
    )


def friction_points(cells: DataFrame, k: int | None = None, at_least: float = 2.0) -> DataFrame:
    """Cells with clearly more complaints than expected, largest first."""
    names = cells.columns[:2]
    strong = cells.where(F.col("residual") >= at_least).orderBy(F.desc("residual"), *names)
    return strong if k is None else strong.limit(k)


def friction_matrix(cells: DataFrame, k: int = 15) -> DataFrame:
    """The k strongest cells as a matrix, zero where a pair is not among them."""
    a, b = cells.columns[:2]
    return friction_points(cells, k).groupBy(a).pivot(b).agg(F.max("residual")).fillna(0.0)


def wilson_bounds(successes: Column, total: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Wilson interval of a proportion, null without observations."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p, z2 = successes / n, F.lit(z * z)
    width = F.lit(1.0) + z2 / n
    center = (p + z2 / (F.lit(2.0) * n)) / width
    margin = F.lit(z) * F.sqrt((p * (F.lit(1.0) - p) + z2 / (F.lit(4.0) * n)) / n) / width
    return F.greatest(center - margin, F.lit(0.0)), F.least(center + margin, F.lit(1.0))


def late_response_rates(themes: DataFrame, dim: str = "theme") -> DataFrame:
    """Late responses per theme with the Wilson interval in percent."""
    groups = themes.groupBy(dim).agg(
        F.count(F.lit(1)).alias("complaints"), F.count(F.when(F.col("not_timely"), 1)).alias("not_timely")
    )
    low, high = wilson_bounds(F.col("not_timely"), F.col("complaints"))
    return groups.select(
        dim, "complaints", "not_timely",
        (F.col("complaints") - F.col("not_timely")).alias("timely"),
        pct(F.col("not_timely"), F.col("complaints")).alias("not_timely_rate_pct"),
        F.when(F.col("complaints") > 0, low * F.lit(100.0)).alias("ci_95_lower_pct"),
        F.when(F.col("complaints") > 0, high * F.lit(100.0)).alias("ci_95_upper_pct"),
    )
