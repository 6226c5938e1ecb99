"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.operators.joins import BROADCAST_BYTES, measured_bytes
from ledgerlake.sources.shared import materialize

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; columns of the input with such a name (in any case) give way."""
    lowered = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered]
    return df.select(*kept, *[column.alias(name) for name, column in columns.items()])


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, so that further columns of the input cannot clash with ours."""
    return df.select(*[F.col(f"`{name}`") for name in names])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] | Column, how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join with ``right`` broadcast only where its measured size allows it.

    Beyond that size both sides are shuffled and adaptive execution splits hot keys.
    """
    on = list(on) if not isinstance(on, Column) else on
    if measured_bytes(right) <= broadcast_bytes:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def running_totals(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], values: Sequence[str]
) -> DataFrame:
    """Add ``<value>_before``: the sum of the rows before, in the order of its group.

    Rows are dealt out by ranges of (group, order), so that a group with a third
    of all rows spreads over many tasks; each range sums its own rows and starts from
    the total of the ranges before.  Group columns must not be null.  Ties take any order.
    """
    numbered = materialize(
        df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    keys = [*groups, "_range"]
    ranges = numbered.groupBy(*keys).agg(*[F.sum(v).alias(f"_{v}_sum") for v in values])
    earlier_ranges = (
        Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per group and range: as many rows in a window as there are ranges.
    offsets = ranges.select(
        *keys,
        *[
            F.coalesce(F.sum(f"_{v}_sum").over(earlier_ranges), F.lit(0)).alias(f"_{v}_offset")
            for v in values
        ],
    )
    earlier_rows = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    within = numbered.select(
        "*", *[F.coalesce(F.sum(v).over(earlier_rows), F.lit(0)).alias(f"_{v}_in") for v in values]
    )
    return (
        within.join(offsets, keys)
        .withColumns({f"{v}_before": F.col(f"_{v}_offset") + F.col(f"_{v}_in") for v in values})
        .drop("_range", *[f"_{v}_{x}" for v in values for x in ("offset", "in")])
    )


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is its smallest node.

    Alternates large-star and small-star steps over rows; nothing but a
    comparison of two sums reaches the driver.  Each step is written to shared storage.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = materialize(ordered.where("a < b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        lows = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(lows, "u")
            .where("v > u")
            .select(F.least("u", "m").alias("a"), F.col("v").alias("b"))
            .where("a < b")
            .distinct()
        )
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(down, "b")
            .select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
            .where("a < b")
            .select("a", "b")
            .distinct()
        )
        current = materialize(small, "edges")
        seen = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1000000007).alias("sum"),
            F.countDistinct("b").alias("nodes"),
        ).first()
        if tuple(seen) == state and seen["n"] == seen["nodes"]:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    leaves = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return leaves.unionByName(roots)


class Memo(dict):
    """Values by word, computed when first asked for; forgets all beyond ``limit`` words."""

    def __init__(self, compute: Callable, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value
