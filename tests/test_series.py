import datetime as dt

import pytest

from conftest import final_plan, rows
from ledgerlake.operators import series
from ledgerlake.sources.shared import materialize

D1, D2, D9 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 9)
SALES = [
    ("north", D1, 0, 1.0, -1.0, 5),
    ("north", D1, 0, 2.0, -2.0, 6),
    ("north", D1, 5, 4.0, -4.0, 7),
    ("north", D9, 3, 1.0, -1.0, 8),
    ("south", D2, 23, 8.0, -8.0, 9),
]


@pytest.fixture(scope="module")
def hourly(spark):
    schema = "district string, event_date date, event_hour int, latitude double, longitude double, quantity_products int"
    return materialize(series.hourly_rollup(spark.createDataFrame(SALES, schema)), "hourly")


def test_rollup(hourly):
    found = {(r["district"], r["event_datetime"]): (r["avg_latitude"], r["sum_quantity_products"])
             for r in hourly.collect()}
    assert found == {
        ("north", dt.datetime(2024, 1, 1, 0)): (1.5, 11),
        ("north", dt.datetime(2024, 1, 1, 5)): (4.0, 7),
        ("north", dt.datetime(2024, 1, 9, 3)): (1.0, 8),
        ("south", dt.datetime(2024, 1, 2, 23)): (8.0, 9),
    }


def test_mean_of_means(hourly):
    means = {r[0]: r[1] for r in series.district_means(hourly).collect()}
    assert means == {"north": (1.5 + 4.0 + 1.0) / 3, "south": 8.0}


def test_grids(hourly):
    every = series.hour_grid(hourly)
    assert every.count() == 2 * 3 * 24
    observed = series.hour_grid(hourly, series.OBSERVED_DAYS)
    assert observed.count() == (2 + 1) * 24
    for grid in (every, observed):
        plan = final_plan(grid)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        series.hour_grid(hourly, "some_days")


def test_gap_fill(hourly):
    filled = {(r["district"], r["event_datetime"]): r for r in series.gap_fill(hourly).collect()}
    assert len(filled) == 144
    gap = filled["north", dt.datetime(2024, 1, 2, 10)]
    assert gap["sum_quantity_products"] == 0
    assert gap["avg_latitude"] == pytest.approx(6.5 / 3)
    kept = filled["north", dt.datetime(2024, 1, 1, 0)]
    assert (kept["avg_latitude"], kept["sum_quantity_products"]) == (1.5, 11)


def test_lags_cross_absent_days(hourly):
    lagged = series.add_lags(series.gap_fill(hourly, series.OBSERVED_DAYS))
    north = {r["event_datetime"]: r for r in lagged.filter("district = 'north'").collect()}
    first = north[dt.datetime(2024, 1, 1, 0)]
    assert all(first[series.lag_column(k)] is None for k in range(1, 7))
    assert north[dt.datetime(2024, 1, 1, 1)]["prev_quantity_products"] == 11
    assert north[dt.datetime(2024, 1, 1, 6)]["prev_quantity_products_6"] == 11
    # 9 January follows 1 January directly: the days between hold no data.
    assert north[dt.datetime(2024, 1, 9, 4)]["prev_quantity_products"] == 8
    assert north[dt.datetime(2024, 1, 9, 0)]["prev_quantity_products_6"] == 0


def test_features_drop_short_history_and_later_hours(hourly):
    features = series.lag_features(hourly, "2024-01-02 12:00:00")
    times = [r["event_datetime"] for r in features.filter("district = 'north'").collect()]
    assert min(times) == dt.datetime(2024, 1, 1, 6)
    assert max(times) == dt.datetime(2024, 1, 2, 12)
    weekdays = {r[0]: r[1] for r in features.select("event_date", "event_weekday").distinct().collect()}
    assert weekdays == {D1: 2, D2: 3}


def test_fill_and_lags_share_one_window(hourly):
    plan = final_plan(series.lag_features(hourly, "2030-01-01"))
    assert plan.count("+- Window") == 1


def test_next_hour_rolls_over_midnight(hourly):
    features = series.lag_features(hourly, "2024-01-02 23:30:00")
    upcoming = {r["district"]: r for r in series.next_hour_rows(features).collect()}
    south = upcoming["south"]
    assert south["event_datetime"] == dt.datetime(2024, 1, 3, 0)
    assert (south["event_date"], south["event_hour"], south["event_weekday"]) == (dt.date(2024, 1, 3), 0, 4)
    assert [south[series.lag_column(k)] for k in range(1, 7)] == [9, 0, 0, 0, 0, 0]
    assert "sum_quantity_products" not in south.asDict()


def test_history_moves_by_one(hourly):
    features = series.lag_features(hourly, "2024-01-01 09:00:00")
    (north,) = series.next_hour_rows(features.filter("district = 'north'")).collect()
    # Quantity 7 was sold at 05:00, five hours before 10:00.
    assert [north[series.lag_column(k)] for k in range(1, 7)] == [0, 0, 0, 0, 7, 0]


def test_observed_grid_features_match_on_dense_days(hourly):
    everywhere = series.lag_features(hourly, "2024-01-01 23:00:00")
    observed = series.lag_features(hourly, "2024-01-01 23:00:00", days=series.OBSERVED_DAYS)
    assert rows(observed) == rows(everywhere.filter("district = 'north'").select(*observed.columns))
