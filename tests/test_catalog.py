"""Every query with an SQL twin is compared with it on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import compare, connect

SMALL = "/root/testdata/sf0.001"
# models are trained in test_models_vectors.py with smaller sizes
LONG = {
    "logistic_metrics", "forest_metrics", "boosting_metrics", "churn_model_compare", "churn_model_predictions", "feature_importance", "coefficient_drivers", "model_risk_explanations",
    "customer_360_from_model",
}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert len(entry(spark).columns) == 46


@pytest.mark.parametrize("name", [n for n in queries() if n in oracle_sql()])
def test_query_equals_sql(spark, con, name):
    verdict = compare(queries()[name](spark, SMALL), con, oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", [n for n in queries() if n not in oracle_sql() and n not in LONG])
def test_query_runs(spark, name):
    assert queries()[name](spark, SMALL).count() > 0
