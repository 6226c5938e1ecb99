"""The sales fact: date enrichment, location, star join.  Batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.functions.times import parse_event_time, with_event_parts
from ledgerlake.operators.joins import BROADCAST_BYTES, SALTS, equal_keys, reference_join
from ledgerlake.operators.spatial import RegionIndex
from ledgerlake.schemas import TABLES


def enrich_dates(bronze_sales: DataFrame) -> DataFrame:
    """Parse the event text into ``event_date`` and add its calendar parts."""
    renamed = bronze_sales.withColumnRenamed("date", "event_date")
    parsed = renamed.withColumn("event_date", parse_event_time(F.col("event_date")))
    return with_event_parts(parsed)


def unreadable_dates(bronze_sales: DataFrame) -> DataFrame:
    """Sales whose event text is present but is no date."""
    text = F.col("date")
    return bronze_sales.filter(text.isNotNull() & parse_event_time(text).isNull())


def region_index(neighborhoods: DataFrame) -> RegionIndex:
    """Cells of the silver neighborhoods, named for the sales table."""
    return RegionIndex(
        neighborhoods.select(
            F.col("name").alias("district"),
            F.col("identification").alias("neighborhood"),
            "geojson",
        )
    )


def to_silver(bronze_sales: DataFrame, regions: RegionIndex, **join_options) -> DataFrame:
    """Silver sales: dated and placed; sales outside every region are dropped."""
    placed = regions.assign(enrich_dates(bronze_sales), **join_options)
    return placed.select(*TABLES["slv_sales"].schema.fieldNames())


def to_gold(
    silver_sales: DataFrame,
    customers: DataFrame,
    employees: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Gold sales: names for customer and employee; sales of unknown people are dropped."""
    people = [
        ("customer_id", customers.select("customer_id", F.col("name").alias("customer"))),
        ("employee_id", employees.select("employee_id", F.col("name").alias("employee"))),
    ]
    named = silver_sales
    for key, person in people:
        joined = reference_join(
            named, person, equal_keys([key]), "inner", broadcast_bytes, salts
        )
        named = joined.select("fact.*", f"side.{person.columns[1]}")
    gold = named.withColumn("event_date", F.col("event_date").cast("date"))
    return gold.select(*TABLES["gld_sales"].schema.fieldNames())
