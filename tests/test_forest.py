"""The forest against its own trees grown in one piece, planted structure and a plain count of a split."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from patronage.operators import boosting, modelling
from patronage.operators.forest import Forest, ForestModel, ForestTrainer, best_splits, class_counts, descend, forest_cuts, grow

ROWS = 600


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=(ROWS, 3)), rng.random(ROWS) < 0.02, np.ones(ROWS)])
    y = (x[:, 0] + 0.5 * x[:, 1] + 3 * x[:, 3] + rng.normal(scale=0.3, size=ROWS) > 0.4).astype(int)
    frame = pd.DataFrame({"id": np.arange(ROWS) // 2, "y": y, "x": list(x)})  # keys come twice
    df = spark.createDataFrame(frame).withColumn("features", array_to_vector(F.col("x")))
    return df.withColumn("id", F.when(F.col("id") % 7 != 0, F.col("id")))


def fitted(rows, **settings) -> ForestModel:
    return ForestTrainer(Forest(trees=12, **settings), "id", "y").fit(rows)


def scored(model, rows):
    found = model.transform(rows).select("x", vector_to_array("probability")[1].alias("p"), "prediction").collect()
    return sorted((tuple(r["x"]), r["p"], r["prediction"]) for r in found)


@pytest.fixture(scope="module")
def whole(rows):
    return fitted(rows)


def test_trees_are_a_table(whole):
    """The driver holds one node a tree; the trainer used before kept every node there."""
    assert all(len(t.feature) == 1 for t in whole.tops)
    table = whole.subtrees.collect()
    assert len(table) == 12 and all(len(r["features"]) // 2 > 5 for r in table)


def test_subtrees_make_the_same_trees(rows, whole):
    """Trees split on the driver's side down to 40 rows are the trees grown in one piece, however rows are dealt."""
    parts = fitted(rows.repartition(5), group_rows=40)
    assert max(len(t.feature) for t in parts.tops) > 15 and parts.subtrees.count() > 12
    assert scored(parts, rows) == scored(whole, rows)
    assert parts.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray(), abs=1e-12)


def test_learns_what_was_planted(rows, whole):
    got = rows.select("x", "y").toPandas().assign(x=lambda d: d["x"].map(tuple)).set_index("x")["y"].to_dict()
    found = scored(whole, rows)
    assert len(found) == ROWS and all(p2 == float(p > 0.5) for _, p, p2 in found)
    assert np.mean([got[x] == p2 for x, _, p2 in found]) > 0.88
    gains = whole.featureImportances.toArray()
    assert gains.sum() == pytest.approx(1) and gains[0] == max(gains) and gains[4] == 0 and gains[3] > 0


def test_splits_against_plain_counts():
    rng = np.random.default_rng(1)
    bins, labels, weights = rng.integers(0, 6, (80, 4)).astype(np.uint8), rng.integers(0, 2, 80).astype(np.uint8), rng.integers(1, 4, 80).astype(np.uint8)
    s = Forest(bins=6, leaf=5)

    def gini(own):
        shares = np.bincount(labels[own], weights[own], 2) / weights[own].sum()
        return 1 - (shares**2).sum()

    best = -1.0
    for f in range(4):
        for cut in range(5):
            left = bins[:, f] <= cut
            n = [weights[left].sum(), weights[~left].sum()]
            if min(n) >= 5:
                best = max(best, gini(np.ones(80, dtype=bool)) - (n[0] * gini(left) + n[1] * gini(~left)) / sum(n))
    slot, place, gain = best_splits(class_counts(np.zeros(80, dtype=int), bins, labels, weights, np.arange(4)[None], s), s)
    assert gain[0] == pytest.approx(best)
    feature, places, child, counts, _ = grow(bins, labels, weights, 0, 0, s)
    ends = descend(feature, places, child, bins)
    for end in np.unique(ends):
        own = np.bincount(labels[ends == end], weights[ends == end], 2)
        assert (counts[end] == own).all() and own.sum() >= 5


def test_stored_and_read_again(whole, rows, tmp_path):
    whole.write().overwrite().save(str(tmp_path / "m"))
    again = ForestModel.load(str(tmp_path / "m"))
    assert scored(again, rows) == scored(whole, rows)


def test_rare_values_have_cuts(rows):
    cuts = forest_cuts(rows, 5, 32)
    assert cuts[3].tolist() == [0.5] and cuts[4].tolist() == [] and all(20 < len(c) < 32 for c in cuts[:3])


def test_splits_are_those_of_sums_over_classes():
    rng, s = np.random.default_rng(3), Forest(bins=8, leaf=5)
    counts = np.repeat(rng.integers(0, 9, (200, 1, 8, 2)), 3, axis=1).astype(float)
    for node in counts:
        node[1], node[2] = node[1, rng.permutation(8)], node[2, rng.permutation(8)]
    whole = counts[:, 0].sum(axis=1)
    left = np.cumsum(counts, axis=2)[:, :, :-1]
    right = whole[:, None, None] - left
    n_left, n_right, n = left.sum(axis=3), right.sum(axis=3), whole.sum(axis=1)
    both = (left**2).sum(axis=3) / np.maximum(n_left, 1) + (right**2).sum(axis=3) / np.maximum(n_right, 1)
    gain = (both - ((whole**2).sum(axis=1) / n)[:, None, None]) / n[:, None, None]
    gain = np.where((n_left >= s.leaf) & (n_right >= s.leaf), gain, -1.0).reshape(200, -1)
    slot, place, most = best_splits(counts, s)
    assert (slot * 7 + place == gain.argmax(axis=1)).all() and (most == gain.max(axis=1)).all()


def test_rows_are_scored_once(spark):
    """Curves and counts each scored the test rows."""
    seen = spark.sparkContext.accumulator(0)

    class Counting:
        def transform(self, df):
            @F.pandas_udf("double")
            def p(x: pd.Series) -> pd.Series:
                seen.add(len(x))
                return x / 100

            scored = df.withColumn("_p", p(F.col("obs_recency_days")))
            return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).withColumn("prediction", (F.col("_p") > 0.5).cast("double"))

    columns = {c: F.lit(0.0) for c in modelling.NUMERIC} | {"obs_recency_days": F.col("id").cast("double"), "churned": (F.col("id") > 40).cast("int")}
    found = modelling.compare_models({"m": Counting()}, spark.range(100).select(*[c.alias(n) for n, c in columns.items()])).collect()
    assert seen.value == 100 and found[0]["true_positive"] == 49 and found[0]["roc_auc"] == 1.0


def test_boosting_rows_are_dealt_to_many_tasks():
    """720,000 training rows went to three tasks."""
    assert 720_000 / boosting.TASK_ROWS > 7
