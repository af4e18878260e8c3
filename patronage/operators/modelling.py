"""Churn models: split, preprocessing, training, evaluation and explanation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from patronage.functions.fixed_values import CHURN_BASE_COLUMNS
from patronage.functions.numeric import ratio, round_half_up
from patronage.functions.rules import flag
from patronage.operators.boosting import Boosting, TreeBooster
from patronage.operators.churn import predictions
from patronage.operators.forest import Forest, ForestTrainer
from patronage.operators.ranking import running_totals, smallest_by_hash
from patronage.session import pin

LABEL, KEY = "churned", "customer_id"
CATEGORICAL = ["obs_country_mode"]
EXCLUDED = [KEY, LABEL, "purchased_in_prediction", "obs_first_purchase_date", "obs_last_purchase_date", *CATEGORICAL]
NUMERIC = [c for c in CHURN_BASE_COLUMNS if c not in EXCLUDED]
#: Partitions of the training rows. Sub-sampled trees depend on it, so it is a parameter and not read from the data.
TRAIN_PARTS = 16
MODEL_NAMES = ["Logistic Regression", "Random Forest", "Gradient Boosting"]


def seeded_order(key: str, seed: int) -> Column:
    """A repeatable pseudo-random sort key."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, label: str = LABEL, key: str = KEY, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train``: exactly the same share of every class, drawn by seeded order."""
    ordered = df.withColumn("_order", seeded_order(key, seed))
    cut = F.floor(F.col("all_rows") * F.lit(train_share) + F.lit(0.5))
    placed = smallest_by_hash(ordered, ["_order", key], cut, [label], "_chosen")
    return placed.withColumn("is_train", flag(F.col("_chosen"))).drop("_order", "_chosen")


def seeded_sample(df: DataFrame, n: int, key: str = KEY, seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement (all if there are fewer), the same ones every time."""
    ordered = df.withColumn("_order", seeded_order(key, seed))
    return smallest_by_hash(ordered, ["_order", key], F.lit(n), out="_chosen").where("_chosen").drop("_order", "_chosen")


def most_frequent_value(df: DataFrame, column: str) -> str | None:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    row = counts.orderBy(F.desc("n"), column).first()
    return row[0] if row else None


def typed(df: DataFrame) -> DataFrame:
    """Model inputs as doubles, the label as 0/1."""
    return df.withColumns({c: F.col(c).cast("double") for c in [*NUMERIC, LABEL]})


def fill_categories(modes: Mapping[str, str | None]) -> SQLTransformer:
    """A stage that puts the training rows' most frequent category in place of a null, when fitting and when scoring."""
    filled = []
    for column, mode in modes.items():
        text = "NULL" if mode is None else "'" + mode.replace("\\", "\\\\").replace("'", "\\'") + "'"
        filled.append(f"coalesce({column}, {text}) AS {column}_filled")
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def preprocessing(scale: bool, modes: Mapping[str, str | None]) -> list:
    """Median and most-frequent imputation (scaled for linear models) and one-hot categories, unknown ones left at zero."""
    imputed = [f"{c}_filled" for c in NUMERIC]
    steps = [
        Imputer(inputCols=NUMERIC, outputCols=imputed, strategy="median", relativeError=0.0001),
        VectorAssembler(inputCols=imputed, outputCol="numeric_raw"),
    ]
    if scale:
        steps.append(StandardScaler(inputCol="numeric_raw", outputCol="numeric", withMean=True, withStd=True))
    filled = [f"{c}_filled" for c in CATEGORICAL]
    indexed = [f"{c}_index" for c in CATEGORICAL]
    hot = [f"{c}_hot" for c in CATEGORICAL]
    steps += [
        fill_categories(modes),
        StringIndexer(inputCols=filled, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=["numeric" if scale else "numeric_raw", *hot], outputCol="features"),
    ]
    return steps


def logistic(n_train: int, c: float = 1.0, max_iter: int = 1000) -> LogisticRegression:
    """Ridge-penalised logistic regression with inverse strength ``c`` over the sum of losses."""
    return LogisticRegression(
        labelCol=LABEL, regParam=1.0 / (c * n_train), elasticNetParam=0.0, standardization=False, maxIter=max_iter
    )


def forest(trees: int = 200, leaf: int = 5, depth: int = 30, seed: int = 42) -> ForestTrainer:
    """Trees grow until leaves are pure or small, or as deep as ``depth``."""
    return ForestTrainer(Forest(trees=trees, leaf=leaf, depth=depth, seed=seed), KEY, LABEL)


def boosting(rounds: int = 200, seed: int = 42) -> TreeBooster:
    """Second-order boosting with rows and columns drawn once for each tree."""
    return TreeBooster(Boosting(rounds=rounds, seed=seed), KEY, LABEL)


def fit_models(
    train: DataFrame, names: Sequence[str] = MODEL_NAMES, parts: int = TRAIN_PARTS, **sizes: int
) -> dict[str, PipelineModel]:
    """Fit the named models on prepared training rows, stored in ``parts`` partitions by key: trainers read them many times."""
    train = pin(typed(train).repartition(parts, KEY).sortWithinPartitions(KEY))
    n_train = train.count()
    modes = {c: most_frequent_value(train, c) for c in CATEGORICAL}
    makers = {
        "Logistic Regression": lambda: (True, logistic(n_train)),
        "Random Forest": lambda: (False, forest(sizes.get("trees", 200))),
        "Gradient Boosting": lambda: (False, boosting(sizes.get("rounds", 200))),
    }
    fitted = {}
    for name in names:
        scale, estimator = makers[name]()
        fitted[name] = Pipeline(stages=[*preprocessing(scale, modes), estimator]).fit(train)
    return fitted


def save_model(model: PipelineModel, path: str) -> None:
    """Store a fitted pipeline, its imputation included, in a shared folder."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the probability of churn."""
    return model.transform(typed(rows)).withColumn("probability_of_churn", vector_to_array("probability")[1])


def churn_predictions(model: PipelineModel, base: DataFrame) -> DataFrame:
    scored = score(model, base).withColumn(LABEL, F.col(LABEL).cast("int"))
    return predictions(scored, F.col("probability_of_churn"))


def threshold_counts(scored: DataFrame, label: str, score_column: str) -> DataFrame:
    """Running true and false positives by descending score; equal scores are one threshold."""
    counts = scored.groupBy((-F.col(score_column).cast("double")).alias("_neg")).agg(
        F.sum(F.col(label).cast("long")).alias("tp"), F.sum(1 - F.col(label).cast("long")).alias("fp")
    )
    counts = counts.withColumn("_all", F.lit(1))
    totals = running_totals(counts, ["_all"], [F.col("_neg")], ["tp", "fp"], ["_neg"])
    return totals.select(
        (-F.col("_neg")).alias("threshold"), "tp", "fp", "cum_tp", "cum_fp",
        F.col("all_tp").alias("positives"), F.col("all_fp").alias("negatives"),
    )


def roc_curve(counts: DataFrame) -> DataFrame:
    return counts.select(
        "threshold",
        ratio(F.col("cum_fp"), F.col("negatives")).alias("false_positive_rate"),
        ratio(F.col("cum_tp"), F.col("positives")).alias("true_positive_rate"),
    )


def precision_recall_curve(counts: DataFrame) -> DataFrame:
    return counts.select(
        "threshold",
        ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
        ratio(F.col("cum_tp"), F.col("positives")).alias("recall"),
    )


def curve_areas(counts: DataFrame) -> DataFrame:
    """ROC area (ties count half) and average precision, from the threshold counts."""
    ranked = F.col("fp") * (F.col("cum_tp") - F.col("tp") / F.lit(2.0))
    precision = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")).cast("double")
    both = F.max("positives") * F.max("negatives")
    return counts.agg(
        ratio(F.sum(ranked), both).alias("roc_auc"),
        ratio(F.sum(F.col("tp") * precision), F.max("positives")).alias("average_precision"),
    )


def confusion(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """Confusion counts with accuracy, precision, recall and F1 in one row."""
    y, p = F.col(label).cast("int"), F.col(predicted).cast("int")

    def count_if(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    cells = scored.agg(
        count_if((y == 0) & (p == 0)).alias("true_negative"),
        count_if((y == 0) & (p == 1)).alias("false_positive"),
        count_if((y == 1) & (p == 0)).alias("false_negative"),
        count_if((y == 1) & (p == 1)).alias("true_positive"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive"))

    def rate(num: Column, den: Column) -> Column:
        return F.coalesce(ratio(num, den), F.lit(0.0))

    return cells.withColumns(
        {
            "accuracy": rate(tp + tn, tp + tn + fp + fn),
            "precision": rate(tp, tp + fp),
            "recall": rate(tp, tp + fn),
            "f1": rate(2 * tp, 2 * tp + fp + fn),
        }
    )


def evaluate(scored: DataFrame, label: str, probability: str, predicted: str, digits: int = 4) -> DataFrame:
    """All metrics of one model in one row, rounded."""
    areas = curve_areas(threshold_counts(scored, label, probability))
    cells = confusion(scored, label, predicted)
    both = cells.withColumn("roc_auc", areas.select("roc_auc").scalar()).withColumn(
        "average_precision", areas.select("average_precision").scalar()
    )
    rounded = {c: round_half_up(F.col(c), digits) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")}
    return both.withColumns(rounded)


def compare_models(models: Mapping[str, PipelineModel], test: DataFrame) -> DataFrame:
    """One metric row per model and a flag on the best by (ROC area, recall)."""
    out = None
    for name, model in models.items():
        scored = pin(score(model, test).select(LABEL, "probability_of_churn", "prediction"))  # read for curves and for counts
        row = evaluate(scored, LABEL, "probability_of_churn", "prediction").withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    best = Window.partitionBy().orderBy(F.desc("roc_auc"), F.desc("recall"), "model")  # one row per model
    return out.withColumn("is_best", F.row_number().over(best) == 1)


def feature_names(model: PipelineModel) -> list[str]:
    """Readable names of the assembled vector, in vector order."""
    indexer = next(s for s in model.stages if s.__class__.__name__ == "StringIndexerModel")
    names = list(NUMERIC)
    for column, labels in zip(CATEGORICAL, indexer.labelsArray):
        names += [f"{column.removeprefix('obs_').removesuffix('_mode')}:{value}" for value in labels]
    return names


def feature_importance(model: PipelineModel) -> DataFrame:
    """Absolute coefficients or split gains by feature, largest first."""
    final = model.stages[-1]
    linear = hasattr(final, "coefficients")
    values = final.coefficients.toArray() if linear else final.featureImportances.toArray()
    kind = "coefficient_magnitude" if linear else "gain"
    rows = [(n, abs(float(v)), kind) for n, v in zip(feature_names(model), values)]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double, importance_type string")
    return frame.orderBy(F.desc("importance"), "feature")


def signed_drivers(coefficients: DataFrame) -> DataFrame:
    """(feature, coefficient) rows with size and direction."""
    up = F.col("coefficient") > 0
    return coefficients.withColumn("abs_coefficient", F.abs("coefficient")).withColumn(
        "direction", F.when(up, "Increases churn risk").otherwise("Decreases churn risk")
    )


def top_drivers(drivers: DataFrame, k: int = 15) -> DataFrame:
    """The k strongest features on either side, under one another."""
    positive = drivers.where(F.col("coefficient") > 0).orderBy(F.desc("coefficient"), "feature").limit(k)
    negative = drivers.where(F.col("coefficient") < 0).orderBy("coefficient", "feature").limit(k)
    return positive.unionByName(negative)


def coefficient_rows(model: PipelineModel) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(feature_names(model), model.stages[-1].coefficients.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, coefficient double")


def linear_contributions(df: DataFrame, key: str, coefficients: Mapping[str, float]) -> DataFrame:
    """(key, feature, phi): coefficient times the distance from the feature's mean, for every row.

    Means are scalar subqueries over the same table; nothing is sampled.
    """
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in coefficients])
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            (F.lit(float(b)) * (F.col(c).cast("double") - means.select(c).scalar())).alias("phi"),
        )
        for c, b in coefficients.items()
    ]
    return df.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.feature", "e.phi")


def model_contributions(model: PipelineModel, base: DataFrame, key: str = KEY, keys: DataFrame | None = None) -> DataFrame:
    """(key, contributions array of (feature, phi)) of a fitted linear model, for every row or those in ``keys``.

    Means are taken over all rows; only then are the rows cut to the few wanted ``keys``.
    """
    names = feature_names(model)
    weights = [float(v) for v in model.stages[-1].coefficients.toArray()]
    vectors = model.transform(typed(base)).select(key, vector_to_array("features").alias("x"))
    means = vectors.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    if keys is not None:
        few = base.join(F.broadcast(keys.select(key)), key, "left_semi")  # the k keys of a top list
        vectors = model.transform(typed(few)).select(key, vector_to_array("features").alias("x"))
    entries = [
        F.struct(F.lit(n).alias("feature"), (F.lit(b) * (F.col("x")[i] - F.lit(float(means[i])))).alias("phi"))
        for i, (n, b) in enumerate(zip(names, weights))
    ]
    return vectors.select(key, F.array(*entries).alias("contributions"))


def top_contributions(rows: DataFrame, k: int = 3, out: str = "top_drivers") -> DataFrame:
    """The k largest contributions of a row as 'name=+0.123 | ...'; sorted inside the row."""
    keyed = F.transform(
        "contributions", lambda c: F.struct((-F.abs(c["phi"])).alias("o"), c["feature"].alias("f"), c["phi"].alias("p"))
    )
    best = F.slice(F.array_sort(keyed), 1, k)
    text = F.transform(best, lambda c: F.concat(c["f"], F.lit("="), F.format_string("%+.3f", c["p"])))
    return rows.withColumn(out, F.concat_ws(" | ", text)).drop("contributions")


def top_risk(scored: DataFrame, base: DataFrame, k: int = 20) -> DataFrame:
    """The k customers most likely to churn with their key observation features."""
    columns = [
        "obs_recency_days", "obs_total_invoices", "obs_total_revenue", "obs_purchase_frequency_per_month",
        "obs_rfm_total_score",
    ]
    top = scored.orderBy(F.desc("churn_probability"), KEY).limit(k)
    found = base.select(KEY, *columns).join(F.broadcast(top.select(KEY)), KEY, "left_semi")  # k keys
    return top.join(found, KEY, "left")


def rule_explanation() -> Column:
    """Why a customer is at risk, from observed behaviour alone."""
    days, orders, spend = F.col("obs_recency_days"), F.col("obs_total_invoices"), F.col("obs_total_revenue")
    reasons = F.concat_ws(
        " | ",
        F.when(days > 90, F.format_string("High inactivity (%dd since last purchase)", days)),
        F.when(orders <= 2, F.format_string("Low purchase frequency (%d orders)", orders)),
        F.when(spend < 500, F.format_string("Low spend (£%.0f)", spend)),
    )
    return F.when(reasons == "", "High churn probability based on combined RFM signals").otherwise(reasons)
