import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronage.operators import ranking


def frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, x double")


CASES = {
    "distinct": list(np.random.default_rng(1).permutation(137)),
    "ties": list(np.random.default_rng(2).integers(0, 9, 200)),
    "hot": [5.0] * 120 + list(range(60)),
    "two": [1.0, 2.0],
}


@pytest.mark.parametrize("name", CASES)
def test_average_rank_share(spark, name):
    values = CASES[name]
    df = frame(spark, values)
    got = ranking.attach_average_ranks(df, "id", ranking.histogram(df, ["x"])).orderBy("id").toPandas()
    assert np.array_equal(got["x_rank"], pd.Series(values, dtype=float).rank(pct=True, method="average"))


@pytest.mark.parametrize("share", [0, 3, 40])
def test_hot_and_cold_values_meet_the_same_ranks(spark, monkeypatch, share):
    """No value hot, a few hot, most hot: the ranks do not change."""
    monkeypatch.setattr(ranking, "HOT_SHARE", share)
    values = pd.Series([7.0] * 70 + list(range(50)) + [1.0] * 30 + [None, None], dtype=float)
    df = frame(spark, [None if pd.isna(v) else v for v in values])
    got = ranking.attach_average_ranks(df, "id", ranking.histogram(df, ["x"])).orderBy("id").toPandas()
    assert np.array_equal(got["x_rank"], values.rank(pct=True, method="average"), equal_nan=True)


def test_first_rows_of_a_hot_group(spark):
    df = spark.createDataFrame([("hot" if i % 5 else "cold", (i * 37) % 500, i) for i in range(500)], "g string, o int, i int")
    got = ranking.first_per_group(df, ["g"], ["o", "i"], 45).toPandas()
    want = df.toPandas().sort_values(["g", "o", "i"]).groupby("g").head(45)
    assert sorted(got["i"]) == sorted(want["i"])


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("higher", [True, False])
def test_rank_quintile(spark, name, higher):
    values = pd.Series(CASES[name], dtype=float)
    got = ranking.rank_quintile(frame(spark, values), "id", "x", "s", higher_is_better=higher).orderBy("id").toPandas()
    want = pd.cut(values.rank(method="first", pct=True), bins=5, labels=[1, 2, 3, 4, 5], include_lowest=True).astype(int)
    assert list(got["s"]) == list(want if higher else 6 - want)


def test_rank_quintile_of_one_row(spark):
    got = ranking.rank_quintile(frame(spark, [3.0]), "id", "x", "s").first()
    want = pd.cut(pd.Series([1.0]), bins=5, labels=[1, 2, 3, 4, 5], include_lowest=True)
    assert got["s"] == int(want[0])


def test_quantile_scores_follow_qcut(spark):
    values = pd.Series(np.random.default_rng(3).normal(size=311).round(1))
    got = ranking.quantile_scores(frame(spark, values), "id", {"s": ("x", True), "t": ("x", False)}).orderBy("id").toPandas()
    want = pd.qcut(values, 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert list(got["s"]) == list(want)
    assert list(got["t"]) == list(6 - want)


@pytest.mark.parametrize("name", ["hot", "two"])
def test_quantile_scores_fall_back_to_ranks(spark, name):
    values = pd.Series(CASES[name], dtype=float)
    got = ranking.quantile_scores(frame(spark, values), "id", {"s": ("x", True)}).orderBy("id").toPandas()
    want = pd.cut(values.rank(method="first", pct=True), bins=5, labels=[1, 2, 3, 4, 5], include_lowest=True).astype(int)
    assert list(got["s"]) == list(want)


def test_quantiles_interpolate_and_skip_nulls(spark):
    values = [4.0, None, 1.0, 9.0, float("nan"), 2.5, float("inf")]
    q = ranking.quantile_values(ranking.histogram(frame(spark, values), ["x"]), [0.0, 0.3, 0.5, 1.0])["x"]
    clean = pd.Series([4.0, 1.0, 9.0, 2.5])
    assert q["n"] == 4 and q["min"] == 1.0 and q["max"] == 9.0
    assert np.allclose(q["q"], [clean.quantile(p) for p in (0.0, 0.3, 0.5, 1.0)])


def test_global_position_within_groups(spark):
    df = spark.createDataFrame([("ab"[i % 2], i * 7 % 10, i) for i in range(40)], "g string, x int, id int")
    got = ranking.global_position(df, ["x", "id"], "p", ["g"]).toPandas()
    want = got.sort_values(["g", "x", "id"]).groupby("g").cumcount() + 1
    assert (got.sort_values(["g", "x", "id"])["p"] == want).all()
    assert set(got["all_rows"]) == {20}


def test_min_max_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (5.0, 3.0)], "x double, y double")
    got = df.select(ranking.min_max("x").alias("x"), ranking.min_max("y").alias("y")).toPandas()
    assert list(got["x"]) == [0.0, 0.25, 1.0] and list(got["y"]) == [0.5] * 3


def test_capped_histogram_counts_all_kept_rows(spark):
    values = list(range(100)) + [10_000]
    got = ranking.capped_histogram(frame(spark, values), "x", 10).toPandas()
    cap = pd.Series(values).quantile(0.95)
    kept = [v for v in values if v <= cap]
    assert got["n"].sum() == len(kept)
    counts, _ = np.histogram(kept, bins=10)
    assert list(got.sort_values("bin")["n"]) == list(counts)


def test_grouped_histogram_shares_the_bins(spark):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(100)], "id long, x double, g string")
    got = ranking.capped_histogram(df, "x", 10, cap_prob=1.0, by="g").toPandas()
    assert len(got) == 20 and got.groupby("bin")["n"].sum().tolist() == np.histogram(range(100), 10)[0].tolist()


def test_distribution_of_constant_column(spark):
    got = ranking.capped_histogram(frame(spark, [2.0] * 5), "x", 10).collect()
    assert [(r["bin"], r["n"]) for r in got] == [(0, 5)]
    assert ranking.quantiles(ranking.histogram(frame(spark, [2.0] * 5), ["x"]), [0.5]).select(F.col("q")[0]).first()[0] == 2.0
