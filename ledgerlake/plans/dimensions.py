"""Dimension tables: staged parquet to bronze, bronze to silver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.functions.geometry import wkb_to_geojson
from ledgerlake.functions.text import trim_strings
from ledgerlake.operators.cleanse import copy_attributes, dedupe_by_key
from ledgerlake.sources.lake import Lake

# Silver names of the staged boundary columns.
MUNICIPALITY_NAMES = {
    "DPTOMPIO": "code",
    "DPTO_CCDGO": "department_code",
    "MPIO_CCDGO": "municipality_code",
    "MPIO_CNMBR": "municipality",
    "MPIO_CCNCT": "ccnct_code",
}
NEIGHBORHOOD_NAMES = {
    "OBJECTID": "object_id",
    "CODIGO": "code",
    "NOMBRE": "name",
    "IDENTIFICACION": "identification",
    "LIMITEMUNICIPIOID": "limit_municipality_id",
    "SUBTIPO_COMUNACORREGIMIENTO": "subtype_community_district",
    "LINK_DOCUMENTO": "link_document",
    "SHAPEAREA": "shape_area",
    "SHAPELEN": "shape_len",
}
# Unnamed areas take these attributes from the donor row (first number).
NEIGHBORHOOD_DONORS = {339: 340, 337: 342}
DONATED_COLUMNS = ["name", "identification", "limit_municipality_id"]


def load_staged(lake: Lake, table: str, directory: str, feed: bool = False) -> int:
    """Merge staged parquet files into a bronze dimension, with ``feed`` also into its change feed."""
    return lake.merge(table, lake.spark.read.parquet(directory), feed=feed)


def clean_people(bronze: DataFrame, key: str) -> DataFrame:
    """Trimmed text and one row per person."""
    return dedupe_by_key(trim_strings(bronze), [key])


def clean_boundaries(bronze: DataFrame, names: dict[str, str]) -> DataFrame:
    """Geometry as GeoJSON text and readable column names."""
    decoded = bronze.withColumn("geojson", wkb_to_geojson(F.col("geometry"))).drop("geometry")
    return decoded.withColumnsRenamed(names)


def clean_neighborhoods(bronze: DataFrame) -> DataFrame:
    """Boundaries with the unnamed areas filled from their donors."""
    return copy_attributes(
        clean_boundaries(bronze, NEIGHBORHOOD_NAMES),
        "object_id",
        NEIGHBORHOOD_DONORS,
        DONATED_COLUMNS,
    )


def refresh_silver(lake: Lake) -> dict[str, int]:
    """Merge all four silver dimensions from bronze; returns written rows per table."""
    cleaned = {
        "slv_customers": clean_people(lake.read("brz_customers"), "customer_id"),
        "slv_employees": clean_people(lake.read("brz_employees"), "employee_id"),
        "slv_municipalities": clean_boundaries(
            lake.read("brz_municipalities"), MUNICIPALITY_NAMES
        ),
        "slv_neighborhoods": clean_neighborhoods(lake.read("brz_neighborhoods")),
    }
    return {table: lake.merge(table, rows) for table, rows in cleaned.items()}


def _affected_neighborhoods(lake: Lake, changed: DataFrame) -> DataFrame:
    """Silver rows of the changed areas and of the areas that take attributes from them."""
    named = {*NEIGHBORHOOD_DONORS, *NEIGHBORHOOD_DONORS.values()}
    ids = {row[0] for row in changed.filter(F.col("OBJECTID").isin(sorted(named))).select("OBJECTID").collect()}
    pairs = {(donor, area) for donor, area in NEIGHBORHOOD_DONORS.items() if ids & {donor, area}}
    takers, needed = {area for _, area in pairs}, {i for pair in pairs for i in pair}
    # A few rows of bronze, picked by key.
    more = lake.read("brz_neighborhoods").filter(F.col("OBJECTID").isin(sorted(needed - ids)))
    cleaned = clean_neighborhoods(changed.unionByName(more))
    return cleaned.filter(~F.col("object_id").isin(sorted(needed - ids - takers)) | F.col("object_id").isNull())


def refresh_silver_from_feed(lake: Lake, consumer: str = "silver") -> dict[str, int]:
    """Merge what the bronze feeds hold since the last call into silver; returns written rows per table.

    Equals :func:`refresh_silver` where all bronze merges wrote their feed.  The mark moves after
    the merge, so a call that was ended reads the same versions again, which changes nothing.
    """
    cleaners = {
        ("brz_customers", "slv_customers"): lambda rows: clean_people(rows, "customer_id"),
        ("brz_employees", "slv_employees"): lambda rows: clean_people(rows, "employee_id"),
        ("brz_municipalities", "slv_municipalities"): lambda rows: clean_boundaries(rows, MUNICIPALITY_NAMES),
        ("brz_neighborhoods", "slv_neighborhoods"): lambda rows: _affected_neighborhoods(lake, rows),
    }
    written = {}
    for (source, target), clean in cleaners.items():
        marks = lake.read("feed_marks").filter((F.col("consumer") == consumer) & (F.col("source") == source))
        mark, latest = marks.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0], lake.feed_version(source)
        written[target] = 0
        if latest > mark:
            written[target] = lake.merge(target, clean(lake.changes_since(source, mark)))
            row = lake.spark.createDataFrame([(consumer, source, latest)], lake.schema_of("feed_marks"))
            lake.merge("feed_marks", row)
    return written
