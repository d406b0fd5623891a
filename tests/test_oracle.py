"""Every registered query against its SQL on the small tables."""

import pytest

from queries.registry import all_oracles, all_queries
from tests.compare import compare, connect

QUERIES, ORACLES = all_queries(), all_oracles()
PYTHON_STEPS = {"score_tiles", "score_pixels", "predict_mosaic", "knn_impute", "normalise_dataset", "dataset_scalers"}


def check_plan(name, df):
    """No Cartesian product, no row-at-a-time Python, Arrow steps only where listed."""
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    if name not in PYTHON_STEPS:
        assert "InPandas" not in text and "ArrowEvalPython" not in text
    return df


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    ok, message, _ = compare(check_plan(name, QUERIES[name](spark, sf_dir)), con, ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert check_plan(name, QUERIES[name](spark, sf_dir)).count() > 0
