"""Contract queries against their SQL, on the smallest tables."""

import pytest

from contract.compare import compare
from contract.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
# Thousands of day directories, streams and models: slow, covered by their own tests.
SLOW = {"partitioned_table_roundtrip", "catalog_view", "training_and_forecast", "incremental_features"}
FAST = [n for n in ORACLES if n not in SLOW and not n.startswith("stream_")]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    count, outcome = compare(spark, SF, name)
    assert outcome == "same" and count > 0


def test_every_query_has_sql_or_is_a_model():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {
        "forecast_rf", "forecast_lr", "forecast_lr_one_hot"
    }


@pytest.mark.parametrize("name", ["spatial_join", "hourly_gap_fill", "gold_star_join", "upsert_classify"])
def test_no_cross_joins(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
