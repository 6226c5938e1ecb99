"""Hourly series per district: roll-up, gap filling, lags and next-hour rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlake.functions.times import hour_start
from ledgerlake.operators.cleanse import latest_per_key
from ledgerlake.sources.shared import materialize

HOUR_KEYS = ["district", "event_date", "event_hour"]
QUANTITY = "sum_quantity_products"
ALL_DAYS, OBSERVED_DAYS = "all_days", "observed_days"


def lag_column(k: int) -> str:
    """Name of the quantity ``k`` hours back."""
    return "prev_quantity_products" if k == 1 else f"prev_quantity_products_{k}"


def _in_time_order():
    return Window.partitionBy("district").orderBy("event_datetime")


def hourly_rollup(sales: DataFrame) -> DataFrame:
    """Quantity and mean position per district and hour."""
    return (
        sales.groupBy(
            "district",
            F.col("event_date").cast("date").alias("event_date"),
            F.col("event_hour").cast("bigint").alias("event_hour"),
        )
        .agg(
            F.avg("latitude").alias("avg_latitude"),
            F.avg("longitude").alias("avg_longitude"),
            F.sum("quantity_products").alias(QUANTITY),
        )
        .withColumn("event_datetime", hour_start(F.col("event_date"), F.col("event_hour")))
    )


def district_means(hourly: DataFrame) -> DataFrame:
    """Mean of the hourly mean positions per district."""
    return hourly.groupBy("district").agg(
        F.avg("avg_latitude").alias("avg_latitude_district"),
        F.avg("avg_longitude").alias("avg_longitude_district"),
    )


def hour_grid(hourly: DataFrame, days: str = ALL_DAYS) -> DataFrame:
    """Every hour each district should have.

    ``all_days`` gives each district all days present in the data,
    ``observed_days`` only its own.  The list of days is one value bounded by
    the calendar, so districts are expanded in place, without a join.
    """
    if days == OBSERVED_DAYS:
        dated = hourly.select("district", "event_date").distinct()
    elif days == ALL_DAYS:
        present = hourly.agg(F.sort_array(F.collect_set("event_date"))).scalar()
        dated = (
            hourly.select("district").distinct()
            .select("district", F.explode(present).alias("event_date"))
        )
    else:
        raise ValueError(f"unknown grid: {days}")
    hours = F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))
    return dated.filter(F.col("event_date").isNotNull()).select(
        "district", "event_date", F.explode(hours).alias("event_hour")
    )


def gap_fill(hourly: DataFrame, days: str = ALL_DAYS) -> DataFrame:
    """Complete hourly series: absent hours get quantity 0 and the district's mean position."""
    # Absent hours are NULL here, so the window mean is the mean of the hourly
    # means.  Ordering the window as the lags do lets both use one shuffle and sort.
    district = _in_time_order().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )

    def or_mean(column: str):
        return F.coalesce(F.col(column), F.avg(column).over(district)).alias(column)

    return observed_series(hour_grid(hourly, days), hourly).select(
        *HOUR_KEYS, "event_datetime", or_mean("avg_latitude"), or_mean("avg_longitude"), QUANTITY
    )


def observed_series(grid: DataFrame, hourly: DataFrame) -> DataFrame:
    """Quantity of every hour of ``grid``, 0 where absent; positions only where observed."""
    return (
        grid.withColumn("event_datetime", hour_start(F.col("event_date"), F.col("event_hour")))
        .join(hourly.drop("event_datetime"), HOUR_KEYS, "left")
        .select(
            *HOUR_KEYS, "event_datetime", "avg_latitude", "avg_longitude",
            F.coalesce(QUANTITY, F.lit(0).cast("bigint")).alias(QUANTITY),
        )
    )


def add_lags(series: DataFrame, lags: int = 6) -> DataFrame:
    """Quantities 1..``lags`` rows back per district, NULL before its first row.

    A district's series holds at most one row per hour of the calendar, which
    bounds the window group however many sales there are.
    """
    w = _in_time_order()
    return series.select(
        "*", *[F.lag(QUANTITY, k).over(w).alias(lag_column(k)) for k in range(1, lags + 1)]
    )


def lag_features(hourly: DataFrame, as_of, lags: int = 6, days: str = ALL_DAYS) -> DataFrame:
    """Feature rows up to ``as_of`` (wall clock); rows without a full history are left out."""
    return up_to(complete_rows(gap_fill(hourly, days), lags), as_of)


def complete_rows(series: DataFrame, lags: int = 6) -> DataFrame:
    """Lags and weekday of a series; rows without a full history are left out."""
    names = [lag_column(k) for k in range(1, lags + 1)]
    return (
        add_lags(series, lags)
        .withColumn("event_weekday", F.dayofweek("event_datetime"))
        .dropna(subset=names)
    )


def up_to(rows: DataFrame, as_of) -> DataFrame:
    return rows.filter(F.col("event_datetime") <= F.lit(as_of).cast("timestamp"))


def demand_features(sales: DataFrame, as_of, lags: int = 6, days: str = ALL_DAYS) -> DataFrame:
    """Feature rows straight from sales.

    The roll-up feeds three branches (districts, days, quantities); it is
    written once so that the sales are scanned once.
    """
    return lag_features(materialize(hourly_rollup(sales), "hourly"), as_of, lags, days)


def next_hour_rows(features: DataFrame, lags: int = 6) -> DataFrame:
    """The row to predict per district: one hour after its latest row, history moved by one."""
    latest = latest_per_key(features, ["district"], "event_datetime")
    upcoming = F.expr("event_datetime + INTERVAL 1 HOUR")
    moved = {
        lag_column(k): F.col(QUANTITY if k == 1 else lag_column(k - 1))
        for k in range(1, lags + 1)
    }
    return latest.withColumns(
        {
            "event_datetime": upcoming,
            "event_date": F.to_date(upcoming),
            "event_hour": F.hour(upcoming).cast("bigint"),
            "event_weekday": F.dayofweek(upcoming),
            **moved,
        }
    ).drop(QUANTITY)
