"""Joins of a large (possibly streaming) side with a reference table of unknown size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    AtomicType,
    BinaryType,
    DataType,
    MapType,
    NullType,
    StringType,
    StructType,
)

# A reference table up to this size is copied to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Copies of a larger reference table where hot keys must be spread beforehand.
SALTS = 8

# Variable-size types without a measure here.
_UNMEASURED = {"variant", "geometry", "geography"}
_UNBOUNDED = 1 << 40

_FACT = "fact"
_SIDE = "side"
_SALT = "_salt"


def _value_bytes(column: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, MapType):
        keys = _value_bytes(F.map_keys(column), ArrayType(kind.keyType))
        return keys + _value_bytes(F.map_values(column), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        fields = [_value_bytes(column[f.name], f.dataType) for f in kind.fields]
        return reduce(lambda a, b: a + b, fields, F.lit(16))
    if isinstance(kind, ArrayType):
        item = kind.elementType
        if isinstance(item, (StringType, BinaryType, ArrayType, MapType, StructType)):
            total = F.aggregate(
                column,
                F.lit(0).cast("bigint"),
                lambda acc, x: acc + _value_bytes(x, item).cast("bigint"),
            )
            return F.coalesce(total, F.lit(0)) + 16
        return F.coalesce(F.size(column), F.lit(0)) * _value_bytes(column, item) + 16
    if isinstance(kind, (AtomicType, NullType)) and kind.typeName() not in _UNMEASURED:
        return F.lit(8)
    # Nothing is known about the size of such values: too large to copy.
    return F.lit(_UNBOUNDED)


def row_bytes(df: DataFrame) -> Column:
    """In-memory size of a row."""
    sizes = [_value_bytes(F.col(f.name), f.dataType).cast("bigint") for f in df.schema.fields]
    return reduce(lambda a, b: a + b, sizes)


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of a batch table, measured by one aggregation over its rows."""
    return df.agg(F.sum(row_bytes(df)).alias("bytes")).first()["bytes"] or 0


def _splits_hot_keys(df: DataFrame) -> bool:
    """Whether Spark itself splits skewed join partitions of this plan at run time."""
    settings = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return not df.isStreaming and all(
        df.sparkSession.conf.get(name, "true") == "true" for name in settings
    )


def reference_join(
    fact: DataFrame,
    side: DataFrame,
    condition: Column,
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    side_bytes: int | None = None,
) -> DataFrame:
    """Join ``fact`` with ``side`` without assuming that ``side`` is small.

    ``condition`` refers to the inputs as ``fact.<column>`` and ``side.<column>``.
    ``side_bytes`` is the side's measured size where the caller already has it.

    * ``side`` measured at or below ``broadcast_bytes``: broadcast, so the large
      side is never shuffled and hot keys do not matter.
    * larger, batch: shuffle join, also where Spark's own threshold is higher; adaptive execution splits hot keys.
    * larger, without adaptive execution (streams): rows of one key are spread
      over ``salts`` tasks, each with a copy of the side's row.
    """
    if side_bytes is None:
        side_bytes = measured_bytes(side)
    if side_bytes <= broadcast_bytes:
        return fact.alias(_FACT).join(F.broadcast(side).alias(_SIDE), condition, how)
    if _splits_hot_keys(fact) or salts <= 1:
        return fact.alias(_FACT).join(side.alias(_SIDE).hint("merge"), condition, how)
    spread = F.pmod(F.xxhash64(*fact.columns), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted = fact.withColumn(_SALT, spread).alias(_FACT)
    copied = side.withColumn(_SALT, copies).alias(_SIDE)
    same_salt = F.col(f"{_FACT}.{_SALT}") == F.col(f"{_SIDE}.{_SALT}")
    return salted.join(copied.hint("merge"), condition & same_salt, how).drop(_SALT)


def equal_keys(keys: list[str], null_safe: bool = False) -> Column:
    """``fact.key = side.key`` for every key; ``null_safe`` also matches NULL with NULL."""
    condition = F.lit(True)
    for key in keys:
        fact, side = F.col(f"{_FACT}.{key}"), F.col(f"{_SIDE}.{key}")
        condition = condition & (fact.eqNullSafe(side) if null_safe else fact == side)
    return condition
