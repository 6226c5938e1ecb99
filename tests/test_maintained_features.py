import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlake.operators.series import hourly_rollup, lag_features
from ledgerlake.plans import maintained_features


def _gold(spark, lake, sales):
    """Gold sales of (district, day of January, hour, quantity, latitude)."""
    base = spark.createDataFrame(
        [(d, datetime.date(2024, 1, day) if day else None, h, q, x, None if x is None else -x) for d, day, h, q, x in sales],
        "district string, event_date date, event_hour int, quantity_products int, latitude double, longitude double",
    )
    names = lake.schema_of("gld_sales").fieldNames()
    return base.withColumns({c: F.lit(None) for c in names if c not in base.columns})


FIRST = [("a", 1, 3, 5, 1.0), ("a", 2, 4, 6, 2.0), ("a", 2, 23, 9, 4.0), (None, 2, 5, 1, 3.0), ("a", None, None, 2, 9.0)]
NEXT = [("a", 5, 0, 7, 5.0), ("a", 5, 1, 7, 16.0), ("a", 5, 1, 2, None), ("c", None, 4, 4, 8.0)]
LATE = [("b", 7, 2, 8, 6.0), ("b", 7, 23, 1, 7.0), ("a", 5, 9, 4, 0.5), (None, 7, 1, 1, 2.0), (None, None, None, 1, 2.0)]


def _equals_full(lake, as_of):
    kept = maintained_features.maintained_features(lake, as_of)
    full = lag_features(hourly_rollup(lake.read("gld_sales")), as_of).select(*kept.columns)
    return rows(kept) == rows(full) and kept.schema.names == lake.schema_of("features_demand_forecast").names


def test_refreshes_equal_a_full_build(spark, lake):
    maintained_features.refresh(lake)
    assert maintained_features.maintained_features(lake, "2024-01-09").count() == 0
    lake.append("gld_sales", _gold(spark, lake, FIRST))
    maintained_features.refresh(lake)
    assert _equals_full(lake, "2024-01-02 12:00:00")
    # Hours that lay after the first ``as_of`` are there later, without another refresh.
    assert _equals_full(lake, "2024-01-03 00:00:00")
    lake.append("gld_sales", _gold(spark, lake, NEXT))
    maintained_features.refresh(lake, "2024-01-05")
    assert _equals_full(lake, "2024-01-09")
    # New districts get all earlier days, later sales of a known day change its rows, new days in between stay absent.
    lake.append("gld_sales", _gold(spark, lake, LATE))
    maintained_features.refresh(lake, "2024-01-05")
    assert _equals_full(lake, "2024-01-09") and _equals_full(lake, "2024-01-07 03:00:00")
    maintained_features.refresh(lake, "2024-01-05")
    assert _equals_full(lake, "2024-01-09")


@pytest.mark.parametrize("since", ["2024-01-01", "2024-02-01"])
def test_first_days_outside_the_data(spark, lake, since):
    lake.append("gld_sales", _gold(spark, lake, FIRST + NEXT))
    maintained_features.refresh(lake)
    maintained_features.refresh(lake, since)
    assert _equals_full(lake, "2024-01-09")


@pytest.mark.parametrize("step", ["district_days", "hourly_features"])
def test_an_ended_refresh_goes_on(spark, lake, monkeypatch, step):
    lake.append("gld_sales", _gold(spark, lake, FIRST))
    maintained_features.refresh(lake)
    lake.append("gld_sales", _gold(spark, lake, LATE))
    replace = lake.replace_partitions

    def ended(table, rows):
        if table == step:
            raise RuntimeError("ended")
        replace(table, rows)

    monkeypatch.setattr(lake, "replace_partitions", ended)
    with pytest.raises(RuntimeError):
        maintained_features.refresh(lake, "2024-01-05")
    monkeypatch.undo()
    maintained_features.refresh(lake, "2024-01-05")
    assert _equals_full(lake, "2024-01-09")


def test_a_refresh_reads_new_days_and_one_before(spark, lake, monkeypatch):
    lake.append("gld_sales", _gold(spark, lake, [("a", day, 8, day, 1.0 * day) for day in range(1, 11)]))
    maintained_features.refresh(lake)
    lake.append("gld_sales", _gold(spark, lake, [("a", 11, 8, 3, 2.0)]))
    replace, scanned = lake.replace_partitions, {}

    def watched(table, rows):
        scanned[table] = rows.inputFiles(), {r[0].day for r in rows.select("event_date").distinct().collect()}
        replace(table, rows)

    monkeypatch.setattr(lake, "replace_partitions", watched)
    maintained_features.refresh(lake, "2024-01-11")
    assert all("event_date=2024-01-11" in f for f in scanned["hourly_sales"][0])
    files, days = scanned["hourly_features"]
    read = {f.split("event_date=")[1][:10] for f in files if "/hourly_sales/" in f}
    assert read == {"2024-01-10", "2024-01-11"} and days == {11}
