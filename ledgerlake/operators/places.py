"""Places in a total order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.sources.shared import materialize

_RANGE, _WITHIN, _BEFORE = "_range", "_within", "_before"


def with_places(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Add each row's place (from 1) in the given order.

    Rows are dealt out by ranges of the order and written once, which fixes the ranges; every
    range numbers its own rows and starts after the rows of the ranges before it.  The order
    should tell all rows apart: rows equal in it share a range, and their places are arbitrary.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = materialize(
        rows.repartitionByRange(*columns).withColumn(_RANGE, F.spark_partition_id()), "ranges"
    )
    # One row per range.
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("_n")).select(
        _RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_BEFORE)
    )
    within = Window.partitionBy(_RANGE).orderBy(*columns)
    return (
        ranges.withColumn(_WITHIN, F.row_number().over(within))
        .join(F.broadcast(starts), _RANGE)
        .withColumn(name, F.col(_BEFORE) + F.col(_WITHIN))
        .drop(_RANGE, _WITHIN, _BEFORE)
    )
