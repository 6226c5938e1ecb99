"""The demand features kept up to date from the new days and a halo of one day.

A feature row needs its own hour, the hours of the lags before it and, where no sale was made
in the hour, the mean position of its district.  That mean moves with every new sale and would
change rows of all history, so it is not stored in them.  Two tables are kept by :func:`refresh`:

* ``district_days``: sum and number of the hourly mean positions per district and day; its
  distinct days and districts are those of the hour grid;
* ``hourly_features``: quantities, lags and observed positions per district and hour.

:func:`maintained_features` puts the means in while reading: one row per district, joined by
measured size.  A refresh reads the gold days from ``since`` on, rolls them up by hour and replaces these
days; the lags of the first of them come from the last day before, as a day of the grid has 24 rows and
lags reach back a day at most.  ``district_days`` is replaced by month.  Only districts that are
seen for the first time get rows on earlier days, which are merged.  Every step computes whole
partitions from its inputs, so a refresh that was ended or is run twice gives the same tables.

Defined cases: sales without a day or an hour name their district but enter no hour; rows without a
district form a series of absent hours without a position, as in ``lag_features``; a refresh on empty
gold writes nothing; days before ``since`` that got sales after the last refresh are not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.operators.joins import equal_keys, reference_join
from ledgerlake.operators.series import complete_rows, hour_grid, hourly_rollup, observed_series, up_to
from ledgerlake.plans.forecast import dated, from_day
from ledgerlake.sources.lake import Lake
from ledgerlake.sources.shared import Scratch

_POSITIONS = ["latitude", "longitude"]


def district_days(hourly: DataFrame) -> DataFrame:
    """Partial means per district and day; they add up over days."""
    on_grid = F.col("event_hour").between(0, 23)
    parts = [
        made(F.when(on_grid, F.col(f"avg_{p}"))).alias(f"{name}_{p}")
        for p in _POSITIONS for name, made in (("sum", F.sum), ("n", F.count))
    ]
    return hourly.groupBy("district", "event_date").agg(*parts).withColumn("month", F.trunc("event_date", "month"))


def refresh(lake: Lake, since=None) -> None:
    """Bring the tables up to date with gold days from ``since`` on, or with all of gold."""
    lake.replace_partitions("hourly_sales", hourly_rollup(dated(from_day(lake.read("gld_sales"), since))))
    hourly = lake.read("hourly_sales")
    months = None if since is None else F.trunc(F.lit(since).cast("date"), "month")
    lake.replace_partitions("district_days", district_days(from_day(hourly, months)))
    with Scratch(lake.spark) as scratch:
        # Districts times calendar days, read by every branch below.
        days = scratch.materialize(lake.read("district_days").select("district", "event_date"), "district-days")
        halo = None
        if since is not None:
            halo = days.filter(F.col("event_date") < F.lit(since).cast("date")).agg(F.max("event_date")).first()[0]
        if halo is None:
            lake.replace_partitions("hourly_features", complete_rows(observed_series(hour_grid(days), hourly)))
            return
        late = scratch.materialize(_without_rows(lake, days, halo), "late-districts")
        if not late.isEmpty():
            lake.merge("hourly_features", _earlier_rows(days, hourly, late, halo))
        on_or_after = F.col("event_date") >= F.lit(halo)
        rows = complete_rows(observed_series(hour_grid(days).filter(on_or_after), hourly.filter(on_or_after)))
        lake.replace_partitions("hourly_features", rows.filter(F.col("event_date") > F.lit(halo)))


def _without_rows(lake: Lake, days: DataFrame, halo) -> DataFrame:
    """Districts without stored rows on the halo day, where every district known before has some."""
    stored = lake.read("hourly_features").filter(F.col("event_date") == F.lit(halo)).select("district").distinct()
    known = equal_keys(["district"], null_safe=True)
    return reference_join(days.select("district").distinct(), stored, known, "left_anti")


def _earlier_rows(days: DataFrame, hourly: DataFrame, late: DataFrame, halo) -> DataFrame:
    """The rows of ``late`` districts up to the halo day."""
    same = equal_keys(["district"], null_safe=True)
    grid = reference_join(hour_grid(days), late, same, "left_semi")
    history = reference_join(hourly, late, same, "left_semi")
    return complete_rows(observed_series(grid, history)).filter(F.col("event_date") <= F.lit(halo))


def maintained_features(lake: Lake, as_of) -> DataFrame:
    """The feature rows up to ``as_of``, equal to ``lag_features`` of all gold sales."""
    dated = lake.read("district_days").filter("event_date is not null")
    means = dated.groupBy("district").agg(
        *[F.try_divide(F.sum(f"sum_{p}"), F.sum(f"n_{p}")).alias(f"mean_{p}") for p in _POSITIONS]
    )
    rows = up_to(lake.read("hourly_features"), as_of)
    filled = {f"avg_{p}": F.coalesce(F.col(f"fact.avg_{p}"), F.col(f"side.mean_{p}")) for p in _POSITIONS}
    joined = reference_join(rows, means, equal_keys(["district"]), "left")
    return joined.select(*[filled.get(c, F.col(f"fact.{c}")).alias(c) for c in rows.columns])
