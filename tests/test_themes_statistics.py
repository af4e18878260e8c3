import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronage.functions.distributions import chi_square_p_value, t_quantile, t_tail, upper_gamma
from patronage.functions.fixed_values import THEMES
from patronage.operators import complaints as cx, contingency, statistics

# theme, complaints, negative, timely, score, rank, tier, lower and upper bound of the late rate
PUBLISHED = [
    ("Transactions / funds disputes", 7853, 6847, 7406, 76.66128268601639, 1, "High Priority"),
    ("Banking / account servicing", 10920, 6728, 10445, 74.68571509832975, 2, "High Priority"),
    ("Debt legitimacy / authorization", 320, 301, 293, 57.68403235009616, 3, "Medium Priority"),
    ("Credit reporting / identity", 5075, 3378, 4927, 51.12676998249622, 4, "Medium Priority"),
    ("Debt verification / FDCPA", 1143, 1141, 1132, 44.898651338730275, 5, "Medium Priority"),
    ("Debt collection / validation", 3235, 1838, 3094, 43.779675481439575, 6, "Medium Priority"),
    ("False credit reporting", 1006, 3, 996, 4.458774328306489, 7, "Lower Priority"),
    ("Credit-report accuracy / rights", 442, 4, 441, 0.7042379355750108, 8, "Lower Priority"),
]


@pytest.fixture(scope="module")
def themes(spark):
    """One row per complaint with the published counts of sentiment and timeliness."""
    data = [(t, n, neg, timely) for t, n, neg, timely, *_ in PUBLISHED]
    counts = spark.createDataFrame(data, "theme string, n int, neg int, timely int")
    rows = counts.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    return rows.select(
        "theme", F.when(F.col("i") <= F.col("neg"), "Negative").otherwise("Neutral").alias("sentiment"),
        (F.col("i") <= F.col("timely")).alias("timely_yes"), (F.col("i") > F.col("timely")).alias("not_timely"),
    ).cache()


def test_priority_scores(themes, rows):
    got = {r["theme"]: r for r in rows(cx.theme_priority(cx.theme_metrics(themes)))}
    for theme, n, neg, timely, score, rank, tier in PUBLISHED:
        row = got[theme]
        assert (row["complaints"], row["negative_complaints"], row["timely_responses"]) == (n, neg, timely)
        assert row["cx_priority_score"] == pytest.approx(score, rel=1e-12)
        assert (row["priority_rank"], row["priority_tier"]) == (rank, tier)
    kpis = cx.priority_kpis(cx.theme_priority(cx.theme_metrics(themes))).first()
    assert (kpis["total_complaints"], kpis["high_priority_themes"], kpis["top_theme"]) == (29994, 2, PUBLISHED[0][0])


def test_theme_timeliness_test(themes):
    got = contingency.chi_square_test(themes, "theme", "timely_yes", "theme").first()
    assert got["chi_square"] == pytest.approx(152.12327922151218, rel=1e-12)
    assert got["degrees_of_freedom"] == 7 and got["statistically_significant"]
    assert got["p_value"] == pytest.approx(1.4538069025546525e-29, rel=1e-9)
    assert got["cramers_v"] == pytest.approx(0.06955862665142537, rel=1e-12)


def test_wilson_intervals(themes, rows):
    got = {r["theme"]: r for r in rows(contingency.late_response_rates(themes))}
    debt, funds = got["Debt legitimacy / authorization"], got["Transactions / funds disputes"]
    assert (debt["not_timely"], debt["complaints"]) == (27, 320)
    assert debt["ci_95_lower_pct"] == pytest.approx(5.863391629830028, rel=1e-12)
    assert debt["ci_95_upper_pct"] == pytest.approx(11.997650323022595, rel=1e-12)
    assert funds["ci_95_lower_pct"] == pytest.approx(5.200986397158599, rel=1e-12)
    assert funds["ci_95_upper_pct"] == pytest.approx(6.226525072004473, rel=1e-12)


def test_yates_applies_at_one_degree_only(spark):
    data = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5 + [(None, "x")] * 9
    df = spark.createDataFrame(data, "p string, q string")
    observed = np.array([[10, 20], [30, 5]])
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / observed.sum()
    got = contingency.chi_square(df, "p", "q").first()
    assert got["chi_square"] == pytest.approx(((abs(observed - expected) - 0.5) ** 2 / expected).sum())
    plain = ((observed - expected) ** 2 / expected).sum()
    assert contingency.chi_square(df, "p", "q", yates=False).first()["chi_square"] == pytest.approx(plain)
    n = observed.sum()
    assert got["cramers_v"] == pytest.approx(math.sqrt(max(0, plain / n - 1 / (n - 1))))


def test_single_column_table_has_no_association(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x")], "p string, q string")
    got = contingency.chi_square(df, "p", "q").first()
    assert (got["degrees_of_freedom"], got["cramers_v"]) == (0, 0.0)


def test_residuals_and_friction(spark, rows):
    rng = np.random.default_rng(5)
    table = pd.DataFrame({"product": rng.choice(list("abc"), 600, p=[0.7, 0.2, 0.1]), "theme": rng.choice(list("uvwx"), 600)})
    table.loc[table["product"] == "c", "theme"] = "u"
    cells = contingency.residuals(spark.createDataFrame(table), "product", "theme")
    observed = pd.crosstab(table["product"], table["theme"])
    expected = np.outer(observed.sum(1), observed.sum(0)) / observed.to_numpy().sum()
    want = (observed - expected) / np.sqrt(expected)
    got = {(r["product"], r["theme"]): r for r in rows(cells)}
    assert len(got) == 12 and got[("c", "v")]["observed"] == 0
    for (p, t), r in got.items():
        assert r["residual"] == pytest.approx(want.loc[p, t], abs=6e-5)
        strength = "Strong" if r["abs_residual"] >= 3 else "Notable" if r["abs_residual"] >= 2 else "Normal"
        assert r["association_strength"] == strength
        assert r["direction"] == ("Higher than expected" if r["residual"] > 0 else "Lower than expected" if r["residual"] < 0 else "Expected")
    friction = contingency.friction_points(cells).collect()
    assert friction[0]["product"] == "c" and all(r["residual"] >= 2 for r in friction)
    matrix = contingency.friction_matrix(cells).collect()
    assert all(v is not None for r in matrix for v in r)


def test_themes_of_topics(spark, rows):
    df = spark.createDataFrame(
        [(1.0, " YES "), (8.0, "no"), (9.0, None), (None, "Yes")], "dominant_topic double, timely_response string"
    )
    got = [(r["theme"], r["timely_yes"], r["not_timely"]) for r in cx.with_theme(df).collect()]
    assert got == [(THEMES[1], True, False), (THEMES[8], False, True), ("Other", False, True), ("Other", True, False)]


def test_null_parent_has_no_share(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), (None, 1)], "product string, t int")
    got = {(r["product"], r["t"]): r["s"] for r in rows(cx.share_within(df, "product", "t", "s"))}
    assert got[("a", 2)] == pytest.approx(200 / 3) and got[(None, 1)] is None


def test_tail_functions(spark):
    assert t_tail(2.0, 5) == pytest.approx(0.10193947882985835, rel=1e-10)
    assert t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-8)
    assert t_quantile(0.975, 1e7) == pytest.approx(1.959964, rel=1e-5)
    assert upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, rel=1e-10)
    row = spark.range(1).select(chi_square_p_value(F.lit(0.0), F.lit(3)).alias("p"), chi_square_p_value(F.lit(None), F.lit(3)).alias("n")).first()
    assert row["p"] == 1.0 and row["n"] is None


def customers(n=400, seed=9):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "customer_id": np.arange(n), "recency_days": rng.integers(0, 40, n).astype(float), "total_invoices": rng.integers(1, 6, n).astype(float),
            "total_revenue": rng.gamma(2, 500, n).round(2), "return_rate": rng.choice([0, 0, 0.5, 1.5], n), "unique_products": rng.integers(1, 30, n).astype(float),
            "purchase_frequency_per_month": rng.uniform(0, 3, n), "unique_purchase_days": rng.integers(1, 9, n).astype(float),
            "has_returned": rng.integers(0, 2, n), "churn_probability": rng.uniform(0, 1, n).round(2),
        }
    )
    frame["customer_health_score"] = (60 - frame["recency_days"] + 4 * frame["total_invoices"] + rng.normal(0, 5, n)).round(2)
    frame["churn_risk_tier"] = rng.choice(["Low Risk", "Medium Risk", "High Risk", "Critical Risk", "Not Scored"], n)
    frame["actual_churned"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-(frame["recency_days"] - 20) / 8))).astype(float)
    frame.loc[::7, "churn_probability"] = np.nan
    return frame


@pytest.fixture(scope="module")
def table(spark):
    return customers()


@pytest.fixture(scope="module")
def c360(spark, table):
    return spark.createDataFrame(table.astype(object).where(table.notna(), None), schema=spark.createDataFrame(table).schema).cache()


def test_describe_with_interval(c360, table, rows):
    got = {r["metric"]: r for r in rows(statistics.describe_with_interval(c360))}
    for metric, r in got.items():
        v = table[metric].dropna()
        margin = v.std() / math.sqrt(len(v)) * t_quantile(0.975, len(v) - 1)
        assert r["n"] == len(v) and r["median"] == pytest.approx(v.median()) and r["std"] == pytest.approx(v.std())
        assert r["ci_95_lower"] == pytest.approx(v.mean() - margin) and r["ci_95_upper"] == pytest.approx(v.mean() + margin)


def test_describe_needs_two_values(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, 7.0, float("inf"))], "total_revenue double, return_rate double, recency_days double")
    assert [r["metric"] for r in statistics.describe_with_interval(df).collect()] == ["total_revenue"]


def test_welch_and_effect_size(c360, table, rows):
    got = statistics.returns_vs_health(c360).first()
    a, b = (table.loc[table["has_returned"] == g, "customer_health_score"] for g in (1, 0))
    se = math.sqrt(a.var() / len(a) + b.var() / len(b))
    assert (got["n1"], got["n2"]) == (len(a), len(b))
    assert got["t_statistic"] == pytest.approx((a.mean() - b.mean()) / se)
    pooled = math.sqrt(((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (len(a) + len(b) - 2))
    assert got["cohens_d"] == pytest.approx((a.mean() - b.mean()) / pooled)
    assert got["p_value"] == pytest.approx(t_tail(got["t_statistic"], got["degrees_of_freedom"]))
    tests = rows(statistics.risk_group_tests(c360))
    high = table[table["churn_risk_tier"].isin(["High Risk", "Critical Risk"])]
    low = table[table["churn_risk_tier"].isin(["Low Risk", "Medium Risk"])]
    for r in tests:
        assert (r["n1"], r["n2"]) == (len(high), len(low)) and r["mean1"] == pytest.approx(high[r["metric"]].mean())
        assert r["difference"] == pytest.approx(high[r["metric"]].mean() - low[r["metric"]].mean())
    assert len(tests) == 5


def test_effect_size_names(spark):
    df = spark.createDataFrame([(d,) for d in [0.19, 0.2, 0.49, 0.5, 0.8, -0.9]], "d double")
    from patronage.functions.fixed_values import EFFECT_SIZES, LARGEST_EFFECT
    from patronage.functions.rules import under

    got = [r[0] for r in df.select(under(F.abs("d"), EFFECT_SIZES, LARGEST_EFFECT)).collect()]
    assert got == ["Negligible", "Small", "Small", "Medium", "Large", "Large"]


def test_spearman_pairwise_complete(c360, table, rows):
    from patronage.functions.fixed_values import CORRELATED_METRICS as metrics

    got = {(r["metric_a"], r["metric_b"]): r["correlation"] for r in rows(statistics.spearman(c360, "customer_id"))}
    assert len(got) == 49
    for a in metrics:
        for b in metrics:
            both = table[[a, b]].dropna() if a != b else table[[a]].dropna()
            ranks = both.rank()
            assert got[(a, b)] == pytest.approx(np.corrcoef(ranks[a], ranks[b])[0, 1], abs=1e-12)


def test_least_squares(c360, table):
    got = {r["feature"]: r for r in statistics.health_regression(c360).collect()}
    features = [f for f in got if f != "const"]
    x = np.column_stack([np.ones(len(table)), table[features]])
    y = table["customer_health_score"].to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    residual = y - x @ beta
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (residual @ residual) / (len(y) - x.shape[1]))
    for name, b, se in zip(["const", *features], beta, errors):
        assert got[name]["coefficient"] == pytest.approx(b, rel=1e-6, abs=1e-9)
        assert got[name]["p_value"] == pytest.approx(t_tail(b / se, len(y) - x.shape[1]), rel=1e-4, abs=1e-9)
    assert got["const"]["r_squared"] == pytest.approx(1 - residual @ residual / ((y - y.mean()) ** 2).sum())


def test_logistic_odds_ratios(c360, table):
    got = {r["feature"]: r for r in statistics.churn_regression(c360).collect()}
    features = [f for f in got if f != "const"]
    x = np.column_stack([np.ones(len(table)), table[features]])
    y, beta = table["actual_churned"].to_numpy(), np.zeros(len(features) + 1)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (p * (1 - p))[:, None]))))
    for name, b, se in zip(["const", *features], beta, errors):
        r = got[name]
        assert r["coefficient"] == pytest.approx(b, rel=1e-4, abs=1e-7)
        assert r["odds_ratio"] == pytest.approx(math.exp(b), rel=1e-4)
        assert r["ci_upper"] == pytest.approx(math.exp(b + 1.959963984540054 * se), rel=1e-3)
    assert got["recency_days"]["significant_at_5pct"]
