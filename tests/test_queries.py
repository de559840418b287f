"""Every query against its SQL on the small tables."""

import pytest

from acreline.queries import REGISTRY
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
MODELS = {"trained_predictions", "feature_importance", "sequential_forecast_with_models"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_matches_sql(spark, duck, name):
    q = REGISTRY[name]
    df = q(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas"):
        assert unwanted not in plan
    problems = [p for p in differences(df, duck, q.sql) if p != "no rows"]
    assert not problems


@pytest.mark.parametrize("name", sorted(MODELS))
def test_model_queries_give_rows(spark, name):
    assert REGISTRY[name](spark, SF).count() > 0


def test_only_model_queries_lack_sql():
    assert {n for n, q in REGISTRY.items() if q.sql is None} == MODELS


def test_entry_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["c_mktsegment", "tax_yr", "av"]
