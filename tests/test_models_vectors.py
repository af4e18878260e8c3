import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import functions as F

from patronage.operators import churn, modelling, topics, vectors
from patronage.plans import customer360 as chain

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    return chain.build_churn_base(spark, SMALL)


@pytest.fixture(scope="module")
def fitted(base):
    split = modelling.stratified_split(base)
    return modelling.fit_models(split.where("is_train = 1"), trees=10, rounds=5), split


def test_split_is_exact_and_repeatable(base, rows):
    split = modelling.stratified_split(base)
    counts = {(r["churned"], r["is_train"]): r["count"] for r in split.groupBy("churned", "is_train").count().collect()}
    for label in (0, 1):
        n = counts[(label, 0)] + counts[(label, 1)]
        assert counts[(label, 1)] == int(0.8 * n + 0.5)
    again = modelling.stratified_split(base.repartition(7))
    keep = lambda df: rows(df.select("customer_id", "is_train"), "customer_id")
    assert keep(split) == keep(again)
    assert keep(split) != keep(modelling.stratified_split(base, seed=7))


def test_seeded_sample(base):
    first = {r[0] for r in modelling.seeded_sample(base, 30).select("customer_id").collect()}
    assert len(first) == 30
    assert first == {r[0] for r in modelling.seeded_sample(base.repartition(5), 30).select("customer_id").collect()}


def brute_metrics(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        picked = s >= t
        recall, precision = y[picked].sum() / y.sum(), y[picked].mean()
        ap, last = ap + (recall - last) * precision, recall
    return auc, ap


def test_evaluation_against_brute_force(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 150), rng.integers(0, 25, 150) / 25
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s, "p": (s >= 0.5).astype(int)}))
    got = modelling.evaluate(df, "y", "s", "p", digits=9).first()
    auc, ap = brute_metrics(y, s)
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-9) and got["average_precision"] == pytest.approx(ap, abs=1e-9)
    tp, fp = ((s >= 0.5) & (y == 1)).sum(), ((s >= 0.5) & (y == 0)).sum()
    assert (got["true_positive"], got["false_positive"]) == (tp, fp)
    assert got["precision"] == pytest.approx(tp / (tp + fp), abs=1e-9)
    roc = modelling.roc_curve(modelling.threshold_counts(df, "y", "s")).toPandas()
    assert len(roc) == len(set(s)) and roc["true_positive_rate"].max() == 1.0 == roc["false_positive_rate"].max()


def test_published_confusion_counts(spark):
    cells = [(0, 0, 359), (0, 1, 147), (1, 0, 129), (1, 1, 374)]
    df = spark.createDataFrame(cells, "y int, p int, n int").select("y", "p", F.explode(F.sequence(F.lit(1), "n")))
    got = modelling.confusion(df, "y", "p").first()
    assert [round(got[c], 4) for c in ("accuracy", "precision", "recall", "f1")] == [0.7265, 0.7179, 0.7435, 0.7305]


def test_models_and_comparison(fitted, base, rows):
    models, split = fitted
    got = rows(modelling.compare_models(models, split.where("is_train = 0")), "model")
    assert {r["model"] for r in got} == set(modelling.MODEL_NAMES) and sum(r["is_best"] for r in got) == 1
    best = max(got, key=lambda r: (r["roc_auc"], r["recall"]))
    assert best["roc_auc"] == next(r for r in got if r["is_best"])["roc_auc"]
    scored = modelling.churn_predictions(models["Logistic Regression"], base)
    assert scored.columns == ["customer_id", "actual_churned", "predicted_churned", "churn_probability", "risk_tier"]
    assert scored.count() == base.count() and scored.where("churn_probability not between 0 and 1").count() == 0


def test_importance_and_drivers(fitted):
    models, _ = fitted
    gains = modelling.feature_importance(models["Random Forest"]).collect()
    assert gains[0]["importance_type"] == "gain" and sum(r["importance"] for r in gains) == pytest.approx(1.0)
    model = models["Logistic Regression"]
    names = modelling.feature_names(model)
    assert len(names) == len(model.stages[-1].coefficients) and any(n.startswith("country:") for n in names)
    drivers = modelling.top_drivers(modelling.signed_drivers(modelling.coefficient_rows(model)), 4).collect()
    assert len(drivers) == 8
    assert all((r["direction"] == "Increases churn risk") == (r["coefficient"] > 0) for r in drivers)


def test_contributions_explain_the_margin(fitted, base):
    """The contributions of a row sum to its margin minus the mean margin."""
    model = fitted[0]["Logistic Regression"]
    rows = modelling.model_contributions(model, base)
    sums = {r["customer_id"]: sum(c["phi"] for c in r["contributions"]) for r in rows.collect()}
    margins = model.transform(modelling.typed(base)).select("customer_id", "rawPrediction").collect()
    margin = {r["customer_id"]: float(r["rawPrediction"][1]) for r in margins}
    mean = np.mean(list(margin.values()))
    assert all(sums[c] == pytest.approx(m - mean, abs=1e-8) for c, m in margin.items())
    text = modelling.top_contributions(rows).first()["top_drivers"]
    assert text.count(" | ") == 2 and "=" in text


def test_linear_contributions(base):
    weights = {"obs_recency_days": 0.5, "obs_total_invoices": -2.0}
    got = modelling.linear_contributions(base, "customer_id", weights).groupBy("feature").agg(F.sum("phi").alias("s")).collect()
    assert {r["feature"] for r in got} == set(weights) and all(abs(r["s"]) < 1e-6 for r in got)


def test_top_risk_and_reasons(spark, base):
    top = modelling.top_risk(churn.recency_score(base), base, 5).withColumn("why", modelling.rule_explanation())
    assert top.count() == 5 and top.where("why is null").count() == 0
    made = spark.createDataFrame(
        [(91, 2, 499.4), (90, 3, 500.0)], "obs_recency_days long, obs_total_invoices long, obs_total_revenue double"
    ).select(modelling.rule_explanation().alias("why")).collect()
    assert made[0]["why"] == "High inactivity (91d since last purchase) | Low purchase frequency (2 orders) | Low spend (£499)"
    assert made[1]["why"] == "High churn probability based on combined RFM signals"


def test_pipeline_round_trip(fitted, base, tmp_path):
    model = fitted[0]["Logistic Regression"]
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (modelling.churn_predictions(m, base).orderBy("customer_id").collect() for m in (model, again))
    assert a == b


def test_null_category_scores_as_the_most_frequent_one(fitted, base):
    model = fitted[0]["Logistic Regression"]
    rows = base.orderBy("customer_id").limit(20)
    mode = modelling.most_frequent_value(fitted[1].where("is_train = 1"), "obs_country_mode")
    a, b = (
        modelling.score(model, rows.withColumn("obs_country_mode", F.lit(v).cast("string"))).orderBy("customer_id").select("probability_of_churn").collect()
        for v in (None, mode)
    )
    assert a == b


def test_correlated_topics_get_exact_weights():
    rng = np.random.default_rng(0)
    h = rng.uniform(0, 1, (8, 300))
    h = 0.7 * h.mean(0) + 0.3 * h
    a = rng.uniform(0, 1, (50, 300)) * (rng.uniform(0, 1, (50, 300)) < 0.05)
    w, unsettled = topics.solve_rows(a @ h.T, h @ h.T, np.zeros((50, 8)))
    gradient = w @ (h @ h.T) - a @ h.T
    assert unsettled == 0 and np.abs(gradient[w > 0]).max() < 1e-6 and gradient[w == 0].min() > -1e-6


def test_unknown_category_is_ignored(fitted, base):
    odd = base.limit(3).withColumn("obs_country_mode", F.lit("NOWHERE"))
    assert modelling.churn_predictions(fitted[0]["Logistic Regression"], odd).count() == 3


def test_planted_topics_are_found(spark):
    groups = {0: ["loan", "rate", "mortgage"], 1: ["card", "fee", "limit"], 2: ["debt", "collector", "call"]}
    rng = np.random.default_rng(0)
    data = []
    for d in range(90):
        for t in groups[d % 3]:
            data.append((d, t, float(rng.uniform(0.4, 1.0))))
        data.append((d, "common", 0.1))
    weights = spark.createDataFrame(data, "id long, term string, weight double")
    model, docs = topics.fit_topics(weights, "id", k=3, max_iter=60, tolerance=1e-7)
    assert all(b <= a + 1e-9 for a, b in zip(model.errors, model.errors[1:]))
    terms = topics.topic_terms(model, docs, 3).collect()
    found = {frozenset(r["term"] for r in terms if r["topic_id"] == t) for t in (1, 2, 3)}
    assert found == {frozenset(g) for g in groups.values()}
    assert {r["rank"] for r in terms} == {1, 2, 3}
    per_doc = topics.dominant_topic(topics.document_topics(model, docs, "id")).collect()
    by_group = {g: {r["dominant_topic"] for r in per_doc if r["id"] % 3 == g} for g in range(3)}
    assert all(len(v) == 1 for v in by_group.values()) and len(set.union(*by_group.values())) == 3
    # error from the sums equals the error of the matrices
    a = np.zeros((90, len(model.terms)))
    for d, t, w in data:
        a[d, model.terms.index(t)] = w
    w = np.zeros((90, 3))
    for r in topics.document_topics(model, docs, "id").collect():
        w[r["id"]] = r["topic_weights"]
    assert ((a - w @ model.components) ** 2).sum() == pytest.approx(model.errors[-1], rel=1e-6)


def test_dominant_topic_takes_the_first_maximum(spark):
    df = spark.createDataFrame([(1, [0.2, 0.7, 0.7]), (2, [0.0, 0.0, 0.0])], "id long, topic_weights array<double>")
    got = [(r["dominant_topic"], r["topic_strength"]) for r in topics.dominant_topic(df).collect()]
    assert got == [(2, 0.7), (1, 0.0)]
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    assigned = {r["id"]: r["dominant_topic"] for r in topics.assign_topics(docs, "id", df).collect()}
    assert assigned == {1: 2, 2: 1, 3: 1}


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(60, 12))
    df = spark.createDataFrame([(f"w{i:02d}", [float(x) for x in v]) for i, v in enumerate(m)], "word string, vector array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = vectors.similar_words(df, ["w03", "w10", "unknown"], 4).collect()
    for i in (3, 10):
        want = [j for j in np.argsort(-(unit @ unit[i])) if j != i][:4]
        mine = sorted((r["rank"], r["word"]) for r in got if r["target_word"] == f"w{i:02d}")
        assert [w for _, w in mine] == [f"w{j:02d}" for j in want]
    concepts = {"pair": ["w01", "w02", "none"], "empty": ["none"]}
    near = vectors.concept_neighbours(df, concepts, 3).collect()
    center = (m[1] + m[2]) / 2
    order = np.argsort(-(unit @ (center / np.linalg.norm(center))))[:3]
    assert sorted((r["rank"], r["word"]) for r in near) == [(k + 1, f"w{j:02d}") for k, j in enumerate(order)]
    assert vectors.similar_words(df, ["none"]).count() == 0


@pytest.mark.parametrize("sizes", [(16_384, 4096, 1024), (7, 3, 2)])
def test_nearest_in_blocks(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK_ROWS", "BLOCK_QUERIES", "SLICE"), sizes, strict=True):
        monkeypatch.setattr(vectors, name, size)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(50, 6))
    m[10:25] = m[9]  # a hot vector: ties in key order
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(50, [0.0] * 6), (51, None)]
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(4)
    queries = spark.createDataFrame([data[i] for i in (3, 9, 12, 30, 50, 51)], "q long, query array<double>")
    found = vectors.nearest(df, "id", "v", queries, 5, "q", True).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (3, 9, 12, 30):
        order = [i for i in sorted(range(50), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i)) if i != q][:5]
        mine = sorted((r["rank"], r["id"], r["similarity"]) for r in found if r["q"] == q)
        assert [i for _, i, _ in mine] == order and np.allclose([s for *_, s in mine], [unit[i] @ unit[q] for i in order])
    assert all(r["similarity"] is None for r in found if r["q"] in (50, 51)) and len(found) == 30
    everything = vectors.nearest(df, "id", "v", queries.where("q = 3"), 100, "q", False)
    assert everything.count() == 52 and everything.where("similarity IS NULL").count() == 2


def test_word_vectors_train_and_persist(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, "loan rate bank loan rate bank" if i % 2 else "card fee limit card fee limit") for i in range(60)], "id long, t string"
    )
    model = vectors.fit_word_vectors(vectors.sentences(docs, "id", "t"), size=8, epochs=3, partitions=1)
    found = vectors.word_vectors(model)
    assert {r["word"] for r in found.collect()} == {"loan", "rate", "bank", "card", "fee", "limit"}
    model.write().overwrite().save(str(tmp_path / "w2v"))
    again = vectors.word_vectors(Word2VecModel.load(str(tmp_path / "w2v")))
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    assert vectors.sentences(spark.createDataFrame([(1, "too few words")], "id long, t string"), "id", "t").count() == 0


def planted_corpus(spark, seed=0, n=240, topics_=6):
    rng = np.random.default_rng(seed)
    data = []
    for d in range(n):
        own = d % topics_
        for j in range(12):
            if rng.random() < 0.6:
                data.append((d, f"t{own}_{j}", float(rng.uniform(0.2, 1.0))))
        for j in range(30):
            if rng.random() < 0.15:
                data.append((d, f"noise{j:02d}", float(rng.uniform(0.0, 0.4))))
    return data, spark.createDataFrame(data, "id long, term string, weight double").repartition(5)


def test_leading_vectors_against_numpy(spark):
    data, weights = planted_corpus(spark)
    docs, terms = topics.document_vectors(weights, "id")
    a = np.zeros((240, len(terms)))
    for d, t, w in data:
        a[d, terms.index(t)] = w
    _, s, vt = np.linalg.svd(a)
    values, found = topics.leading_vectors(docs, len(terms), 6, passes=4)
    assert np.allclose(values, s[:6], rtol=1e-3)
    assert np.allclose(np.abs((found * vt[:6].T).sum(axis=0)), 1.0, atol=1e-2)


def plain_decomposed_start(a, k):
    """Topic-term side of the published start: leading singular pairs split by sign, zeros filled with the mean."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    h = np.zeros((k, a.shape[1]))
    h[0] = np.sqrt(s[0]) * np.abs(vt[0])
    for j in range(1, k):
        sides = []
        for sign in (1, -1):
            x, y = np.maximum(sign * u[:, j], 0), np.maximum(sign * vt[j], 0)
            sides.append((np.linalg.norm(x) * np.linalg.norm(y), y / max(np.linalg.norm(y), 1e-300)))
        weight, y = max(sides, key=lambda p: p[0])
        h[j] = np.sqrt(s[j] * weight) * y
    h[h < 1e-6] = 0
    return np.where(h == 0, a.mean(), h)


def test_decomposed_start(spark):
    data, weights = planted_corpus(spark)
    docs, terms = topics.document_vectors(weights, "id")
    a = np.zeros((240, len(terms)))
    for d, t, w in data:
        a[d, terms.index(t)] = w
    assert np.allclose(topics.decomposed_start(docs, len(terms), 6, passes=10), plain_decomposed_start(a, 6), atol=1e-3)
    near, far = (topics.fit_topics(weights, "id", k=6, max_iter=4, tolerance=0, start=start)[0] for start in ("decomposed", "random"))
    # its first error, and the error after the same few rounds, are below those of a random start
    assert near.errors[0] < far.errors[0] and near.errors[-1] < far.errors[-1]
    found = {frozenset(r["term"].split("_")[0] for r in topics.topic_terms(near, docs, 8).where(f"topic_id = {t}").collect()) for t in range(1, 7)}
    assert found == {frozenset([f"t{j}"]) for j in range(6)}


def test_topics_of_empty_weights(spark):
    model, docs = topics.fit_topics(spark.createDataFrame([], "id long, term string, weight double"), "id", k=3)
    assert model.terms == [] and docs.count() == 0


def test_weights_are_exchanged_not_swept(monkeypatch):
    """A well-conditioned system needs no sweeps, and its weights are those that the sweeps approach."""
    rng = np.random.default_rng(1)
    h = rng.uniform(0, 1, (8, 200)) * (rng.uniform(0, 1, (8, 200)) < 0.5)
    target, gram = rng.normal(0, 1, (400, 200)) @ h.T, h @ h.T
    gram[:, 3] = gram[3, :] = target[:, 3] = 0.0
    start = np.full((400, 8), 0.5)
    slow, _ = topics._swept(target, gram, start, 1e-13)
    monkeypatch.setattr(topics, "MOST_SWEEPS", 0)
    found, unsettled = topics.solve_rows(target, gram, start)
    assert unsettled == 0 and np.allclose(found, slow, atol=1e-9) and (found[:, 3] == 0.5).all()
    assert topics.solve_rows(target[:0], gram, start[:0])[0].shape == (0, 8)


def test_singular_weights_are_swept():
    h = np.array([[1.0, 0, 1], [1.0, 0, 1], [0, 1.0, 0]])
    w, unsettled = topics.solve_rows(np.array([[2.0, 2, 5]]), h @ h.T, np.zeros((1, 3)))
    assert unsettled == 0 and np.allclose(w @ h, [[1.0, 5, 1]])
