"""Keyed upsert over plain tables.

A source row replaces the target row of the same key, unmatched source rows are
added and all other target rows stay.  Keys match by plain equality, so rows
with a NULL key never match and are kept on both sides; with ``null_safe``, meant
for computed tables, a NULL key matches a NULL key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.operators.joins import BROADCAST_BYTES, equal_keys, reference_join


class DuplicateSourceKeys(ValueError):
    """More than one source row claims the same key."""


def require_unique_keys(source: DataFrame, keys: list[str], null_safe: bool = False) -> None:
    """Fail when two source rows carry the same key (NULL keys count if ``null_safe``)."""
    known = source if null_safe else source.dropna(subset=keys)
    repeated = known.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise DuplicateSourceKeys(f"source has several rows for {repeated[0].asDict()}")


def _distinct_from(columns: list[str]) -> Column:
    """Any of ``columns`` differs between the sides; two NULLs are equal."""
    if not columns:
        return F.lit(False)
    return reduce(
        lambda a, b: a | b,
        [~F.col(f"fact.{c}").eqNullSafe(F.col(f"side.{c}")) for c in columns],
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    check_source: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
    null_safe: bool = False,
) -> DataFrame:
    """Target after merging ``source`` into it.

    Only the source keys travel: target rows whose key the source replaces are
    removed by an anti join (a broadcast while the source is small, so the
    large target is not shuffled) and the source rows are added.
    """
    if check_source:
        require_unique_keys(source, keys, null_safe)
    incoming = source.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    )
    kept = reference_join(
        target, incoming.select(*keys), equal_keys(keys, null_safe), "left_anti", broadcast_bytes
    )
    return kept.unionByName(incoming)


def _touched(
    target: DataFrame, source: DataFrame, keys: list[str], compare: list[str],
    broadcast_bytes: int, null_safe: bool = False,
) -> DataFrame:
    """Target rows whose key occurs in the source; a small source leaves the target unshuffled."""
    return reference_join(
        target.select(*keys, *compare),
        source.select(*keys),
        equal_keys(keys, null_safe),
        "left_semi",
        broadcast_bytes,
    )


def changes(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    compare: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    null_safe: bool = False,
) -> DataFrame:
    """Source rows that would change the target: new keys and rows that differ from it."""
    compare = [c for c in target.columns if c not in keys] if compare is None else compare
    touched = _touched(target, source, keys, compare, broadcast_bytes, null_safe)
    # An equal target row hides the source row.
    same = equal_keys(keys, null_safe) & ~_distinct_from(compare)
    return source.alias("fact").join(touched.alias("side"), same, "left_anti")


def classify_changes(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    compare: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Keys of both sides with ``change``: insert, update, unchanged or target_only.

    Two joins that keep one side each, instead of a full outer join: both can
    broadcast a small source and both can be split where keys are skewed.
    """
    compare = [c for c in target.columns if c not in keys] if compare is None else compare
    touched = _touched(target, source, keys, compare, broadcast_bytes)
    here = touched.withColumn("_here", F.lit(True)).alias("side")
    change = (
        F.when(F.col("side._here").isNull(), "insert")
        .when(_distinct_from(compare), "update")
        .otherwise("unchanged")
    )
    arriving = source.alias("fact").join(here, equal_keys(keys), "left").select(
        *[F.col(f"fact.{k}") for k in keys], change.alias("change")
    )
    remaining = reference_join(
        target.select(*keys), source.select(*keys), equal_keys(keys), "left_anti", broadcast_bytes
    ).withColumn("change", F.lit("target_only"))
    return arriving.unionByName(remaining)


def count_changes(
    target: DataFrame, source: DataFrame, keys: list[str], compare: list[str] | None = None
) -> DataFrame:
    """Number of rows per change class."""
    return classify_changes(target, source, keys, compare).groupBy("change").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
