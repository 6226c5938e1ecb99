import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.operators.series import hourly_rollup, lag_features
from ledgerlake.plans import forecast


def _gold(spark, lake, sales):
    """Gold sales of (district, day of January, hour, quantity, latitude)."""
    base = spark.createDataFrame(
        [(d, datetime.date(2024, 1, day) if day else None, h, q, x, -x) for d, day, h, q, x in sales],
        "district string, event_date date, event_hour int, quantity_products int, "
        "latitude double, longitude double",
    )
    names = lake.schema_of("gld_sales").fieldNames()
    return base.withColumns({c: F.lit(None) for c in names if c not in base.columns})


def test_refresh_of_new_days_equals_a_full_build(spark, lake):
    first = [("a", 1, 3, 5, 1.0), ("a", 2, 4, 6, 2.0), (None, 2, 5, 1, 3.0), ("a", None, None, 2, 9.0)]
    later = [("a", 3, 1, 7, 5.0), ("b", 3, 2, 8, 6.0), ("b", None, 7, 1, 4.0), ("a", None, None, 3, 8.0)]
    lake.append("gld_sales", _gold(spark, lake, first))
    forecast.refresh_features(lake, "2024-01-02 23:00:00")
    lake.append("gld_sales", _gold(spark, lake, later))
    as_of = "2024-01-03 23:00:00"
    forecast.refresh_features(lake, as_of, since="2024-01-03")
    stored = lake.read("features_demand_forecast")
    hourly = lake.read("hourly_sales").count()
    full = lag_features(hourly_rollup(lake.read("gld_sales")), as_of)
    assert rows(stored) == rows(full, *stored.columns)
    # Unchanged sales write nothing, with and without a first day.
    assert forecast.refresh_hourly(lake) == forecast.refresh_hourly(lake, "2024-01-03") == 0
    count = stored.count()
    assert forecast.refresh_features(lake, as_of) == 0
    assert lake.read("features_demand_forecast").count() == count
    assert lake.read("hourly_sales").count() == hourly


@pytest.mark.parametrize("kind", ["struct<x: string>", "map<string, string>", "array<struct<x: string>>"])
def test_nested_values_count_in_full(spark, kind):
    from ledgerlake.operators.joins import measured_bytes

    made = {
        "struct<x: string>": F.struct(F.repeat(F.lit("x"), 10_000).alias("x")),
        "map<string, string>": F.create_map(F.lit("k"), F.repeat(F.lit("x"), 10_000)),
        "array<struct<x: string>>": F.array(F.struct(F.repeat(F.lit("x"), 10_000).alias("x"))),
    }[kind]
    assert measured_bytes(spark.range(10).select(made.cast(kind).alias("v"))) > 100_000
    assert measured_bytes(spark.range(10).select(F.parse_json(F.lit("{}")).alias("v"))) > 1 << 40
