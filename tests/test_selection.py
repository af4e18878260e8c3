"""Quantiles by brackets, selection by hash cells, sparse contingency tables and folded distinct counts against plain versions."""

import collections
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronage.operators import contingency, features, ranking, sales
from patronage.operators.ranking import exact_quantiles, first_per_group, smallest_by_hash


@pytest.mark.parametrize("accuracy", [3, 50, 2000])
def test_quantiles_equal_interpolated_ones(spark, accuracy):
    rng = np.random.default_rng(6)
    columns = {
        "smooth": rng.lognormal(size=3000), "ties": rng.integers(0, 4, 3000).astype(float), "constant": np.full(3000, 2.5),
        "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000)), "holes": np.where(rng.random(3000) < 0.3, np.nan, rng.normal(size=3000)),
        "far": np.append(rng.normal(size=2999), 1e300),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).withColumn("empty", F.lit(None).cast("double")).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    found = {r["metric"]: r for r in exact_quantiles(df, [*columns, "empty"], probs, accuracy).collect()}
    assert "empty" not in found
    for name, values in columns.items():
        values = values[~np.isnan(values)]
        assert (found[name]["n"], found[name]["min"], found[name]["max"]) == (len(values), values.min(), values.max())
        assert found[name]["q"] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)


def test_quantiles_sort_no_table(spark):
    df = spark.range(1000).select(F.rand(1).alias("v"))
    assert exact_quantiles(df, ["v"], [0.5]).count() == 1
    assert exact_quantiles(df.limit(0), ["v"], [0.5]).count() == 0
    one = exact_quantiles(df.limit(1), ["v"], [0.5, 0.1]).first()
    assert one["q"] == [one["min"], one["max"]]


def digest(value):
    return hashlib.md5(str(value).encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_selection_equals_an_ordered_one(spark, monkeypatch, digits):
    monkeypatch.setattr(ranking, "CELL_DIGITS", digits)
    rows = [(i, "ab"[i % 7 == 0], i % 3) for i in range(900)] + [(i, None, 0) for i in range(900, 960)]
    df = spark.createDataFrame(rows, "id long, g string, other int").withColumn("h", F.md5(F.col("id").cast("string"))).repartition(6)
    for share in (0.0, 0.37, 0.8, 1.0):
        found = smallest_by_hash(df, ["h", "id"], F.floor(F.col("all_rows") * F.lit(share) + F.lit(0.5)), ["g"])
        assert found.columns == ["id", "g", "other", "h", "chosen"]
        got = {r["id"] for r in found.where("chosen").collect()}
        want = set()
        for g in ("a", "b", None):
            ids = sorted((i for i, x, _ in rows if x == g), key=lambda i: (digest(i), i))
            want |= set(ids[: int(len(ids) * share + 0.5)])
        assert got == want and found.count() == len(rows)
    ordered = sorted(range(960), key=lambda i: (digest(i), i))
    for n in (0, 1, 500, 2000):
        assert {r["id"] for r in smallest_by_hash(df, ["h", "id"], F.lit(n)).where("chosen").collect()} == set(ordered[:n])


def test_selection_of_nothing(spark):
    df = spark.createDataFrame([], "id long, h string")
    assert smallest_by_hash(df, ["h", "id"], F.lit(3)).count() == 0


@pytest.mark.parametrize("k", [2, 5000])
def test_first_per_group(spark, k):
    rows = [(i, None if i % 11 == 0 else i % 3, (i * 7919) % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, o int").repartition(4)
    groups = collections.defaultdict(list)
    for i, g, o in rows:
        groups[g].append((o, i))
    want = {i for members in groups.values() for _, i in sorted(members)[:k]}
    assert {r["id"] for r in first_per_group(df, ["g"], ["o", "id"], k).collect()} == want
    plan = first_per_group(df, ["g"], ["o", "id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "rangepartitioning" not in plan


def plain_chi(pairs):
    n, r, c = len(pairs), collections.Counter(a for a, _ in pairs), collections.Counter(b for _, b in pairs)
    o = collections.Counter(pairs)
    gaps = [(abs(o[a, b] - r[a] * c[b] / n), r[a] * c[b] / n) for a in r for b in c]
    return sum(g * g / e for g, e in gaps), sum((g - min(g, 0.5)) ** 2 / e for g, e in gaps), len(r), len(c)


def test_sparse_chi_square(spark):
    rng = np.random.default_rng(9)
    for a, b in ((2, 2), (3, 5), (1, 4), (2, 1)):
        pairs = [(int(x) % a, int(y) % b) for x, y in zip(rng.integers(0, 9, 200), rng.integers(0, 7, 200), strict=True)]
        pairs += [(0, 0)] * 40
        df = spark.createDataFrame([*pairs, (None, 1), (1, None)], "a int, b int")
        plain, corrected, rows, cols = plain_chi(pairs)
        found = contingency.chi_square(df, "a", "b").first()
        assert (found["n"], found["n_rows"], found["n_cols"], found["degrees_of_freedom"]) == (len(pairs), rows, cols, (rows - 1) * (cols - 1))
        assert found["chi_square"] == pytest.approx(corrected if (rows, cols) == (2, 2) else plain, abs=1e-9)


def test_wide_tables(spark):
    df = spark.range(40_000).select((F.col("id") % 12_000).alias("a"), (F.col("id") % 11).alias("b"))
    found = contingency.chi_square(df, "a", "b").first()
    assert found["n_rows"] == 12_000 and found["n_cols"] == 11
    cells = df.where("a < 50").select("a", "b")
    full, sparse = (contingency.residuals(cells, "a", "b", zero).collect() for zero in (True, False))
    assert len(full) == 50 * 11 and sorted(r for r in full if r["observed"]) == sorted(sparse)
    assert contingency.crosstab(df.limit(0), "a", "b").count() == 0


def test_folded_sizes_expand_no_line(spark):
    rows = [(f"i{i % 40}", i % 9 if i % 5 else None, f"p{i % 17}" if i % 7 else None, "xyz"[i % 3], float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "invoice string, customer int, product string, country string, value double").repartition(4)
    found = sales.line_sizes(df, "invoice", "customer", "product", "country", {"n": ("count", F.count("value")), "most": ("max", F.max("value"))})
    row = found.first()
    distinct = [len({r[i] for r in rows} - {None}) for i in range(4)]
    assert [row[c] for c in ("unique_invoices", "unique_customers", "unique_products", "unique_countries")] == distinct
    assert (row["n"], row["most"]) == (400, 399.0)


def expanded(df):
    """What lies under each Expand of the optimised plan: only aggregates may."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    under = []
    for i, line in enumerate(lines):
        if "Expand [" in line:
            under.append(next(x.strip(" :+-") for x in lines[i + 1:] if "Project" not in x).split(" ")[0])
    return under


def test_no_line_is_expanded(spark):
    from catalog.queries import QUERIES, lines, raw
    from patronage.operators import quality

    folder = "/root/testdata/sf0.001"
    assert set(expanded(QUERIES["dataset_overview"](spark, folder))) == {"Aggregate"}
    assert set(expanded(quality.raw_audit(raw(spark, folder)))) == {"Aggregate"}
    assert set(expanded(features.customer_base(lines(spark, folder, *features.SALES_COLUMNS)))) == {"Aggregate"}
