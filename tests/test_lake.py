import datetime as dt

import pytest

from conftest import rows
from ledgerlake.operators.upsert import DuplicateSourceKeys
from ledgerlake.plans import dimensions
from ledgerlake.schemas import TABLES
from test_geometry import CASES, SQUARE, polygon

PEOPLE = "customer_id bigint, name string, phone string, email string, address string"


def people(spark, *data):
    return spark.createDataFrame([(*d, None, None, None) for d in data], PEOPLE)


def test_tables_exist_with_declared_layout(spark, lake):
    lake.ensure()
    for name, spec in TABLES.items():
        stored = lake.schema_of(name)
        assert {f.name: f.dataType for f in stored} == {f.name: f.dataType for f in spec.schema}
        assert lake.read(name).count() == 0
        partitions = [c.name for c in spark.catalog.listColumns(lake.name(name)) if c.isPartition]
        assert partitions == spec.partition_by


def test_merge_writes_only_what_changed(spark, lake):
    assert lake.merge("slv_customers", people(spark, (1, "a"), (2, "b"))) == 2
    assert lake.merge("slv_customers", people(spark, (1, "a"), (2, "b"))) == 0
    assert lake.merge("slv_customers", people(spark, (1, "a"), (2, "c"), (3, "d"))) == 2
    assert rows(lake.read("slv_customers"), "customer_id", "name") == [(1, "a"), (2, "c"), (3, "d")]


def test_earlier_snapshot_stays_readable_until_dropped(spark, lake):
    lake.merge("slv_customers", people(spark, (1, "a")))
    before = lake.read("slv_customers")
    lake.merge("slv_customers", people(spark, (1, "z")))
    assert rows(before, "name") == [("a",)]
    assert lake.drop_old_snapshots("slv_customers") >= 1
    assert rows(lake.read("slv_customers"), "name") == [("z",)]
    assert lake.drop_old_snapshots("slv_customers") == 0


def test_duplicate_source_leaves_table_alone(spark, lake):
    lake.merge("slv_customers", people(spark, (1, "a")))
    with pytest.raises(DuplicateSourceKeys):
        lake.merge("slv_customers", people(spark, (1, "x"), (1, "y")))
    assert rows(lake.read("slv_customers"), "name") == [("a",)]


def test_tables_without_keys_cannot_be_merged(spark, lake):
    with pytest.raises(ValueError):
        lake.merge("gld_sales", lake.read("gld_sales"))


def feature_rows(spark, *data):
    lags = ", ".join(f"0L AS {c}" for c in TABLES["features_demand_forecast"].schema.fieldNames()
                     if c.startswith("prev_"))
    base = spark.createDataFrame(
        [(d, dt.datetime(2024, 1, day, hour), q) for d, day, hour, q in data],
        "district string, event_datetime timestamp, sum_quantity_products bigint",
    )
    return base.selectExpr("*", "to_date(event_datetime) AS event_date", "hour(event_datetime) AS event_hour",
                           "0D AS avg_latitude", "0D AS avg_longitude", "1 AS event_weekday", *lags.split(", "))


def test_partitioned_merge_rewrites_touched_days_only(spark, lake):
    table = "features_demand_forecast"
    lake.merge(table, feature_rows(spark, ("n", 1, 0, 1), ("n", 2, 0, 2), ("s", 2, 0, 3)))
    untouched = [f for f in lake.read(table).inputFiles() if "event_date=2024-01-01" in f]
    assert lake.merge(table, feature_rows(spark, ("n", 2, 0, 9), ("n", 3, 1, 4), ("s", 2, 0, 3))) == 2
    assert rows(lake.read(table), "district", "event_hour", "sum_quantity_products") == [
        ("n", 0, 1), ("n", 0, 9), ("n", 1, 4), ("s", 0, 3)
    ]
    assert [f for f in lake.read(table).inputFiles() if "event_date=2024-01-01" in f] == untouched


def test_dimensions_from_staging_to_silver(spark, lake, tmp_path):
    staged = {
        "brz_customers": people(spark, (1, " Ana "), (2, "Ben")),
        "brz_employees": spark.createDataFrame(
            [(5, " Eva", None, None, None, 0.1)], TABLES["brz_employees"].ddl),
        "brz_municipalities": spark.createDataFrame(
            [("05001", "05", "001", " Town ", "05001", bytearray(polygon(SQUARE)))],
            TABLES["brz_municipalities"].ddl),
        "brz_neighborhoods": spark.createDataFrame(
            [(339, "a", "Rural", "R1", "m", 1, None, 1.0, 2.0, bytearray(polygon(SQUARE))),
             (340, "b", None, None, None, 2, None, 1.0, 2.0, None),
             (342, "c", "Kept", None, None, 2, None, 1.0, 2.0, bytearray(b"\x01"))],
            TABLES["brz_neighborhoods"].ddl),
    }
    for table, df in staged.items():
        df.write.parquet(str(tmp_path / table))
        assert dimensions.load_staged(lake, table, str(tmp_path / table)) == df.count()
        assert dimensions.load_staged(lake, table, str(tmp_path / table)) == 0
    assert sum(dimensions.refresh_silver(lake).values()) == 7
    assert sum(dimensions.refresh_silver(lake).values()) == 0
    assert rows(lake.read("slv_customers"), "name") == [("Ana",), ("Ben",)]
    assert rows(lake.read("slv_employees"), "name", "comission") == [("Eva", 0.1)]
    # Boundary text is not trimmed.
    assert rows(lake.read("slv_municipalities"), "code", "municipality", "geojson") == [
        ("05001", " Town ", CASES["polygon"][1])
    ]
    assert rows(lake.read("slv_neighborhoods"), "object_id", "name", "identification", "geojson") == [
        (339, "Rural", "R1", CASES["polygon"][1]),
        (340, "Rural", "R1", None),
        (342, "Kept", None, None),
    ]
