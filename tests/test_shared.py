import datetime as dt
from pathlib import Path
from types import SimpleNamespace

from conftest import final_plan
from ledgerlake.sources.shared import Scratch, materialize, shared_path, shared_root


def test_working_tables_live_in_the_cluster_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark).startswith(base)
    assert shared_path(spark, "a") != shared_path(spark, "a")


def test_unset_folder_falls_back_to_one_place(spark):
    bare = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default), sparkContext=spark.sparkContext
    )
    assert shared_root(bare) == shared_root(bare) != shared_root(spark)


def test_written_table_keeps_schema_and_prunes_columns(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS twice", "array(id) AS many")
    written = materialize(df, "numbers")
    assert written.schema.simpleString() == df.schema.simpleString()
    plan = final_plan(written.select("twice").filter("twice > 4"))
    assert "ReadSchema: struct<twice:bigint>" in plan and "GreaterThan(twice,4)" in plan


def test_scratch_tables_go_when_the_step_ends(spark, lake):
    with Scratch(spark) as scratch:
        assert scratch.materialize(spark.range(3).toDF("id"), "short").count() == 3
        (path,) = scratch.paths
        assert Path(path.removeprefix("file:")).exists()
    assert not Path(path.removeprefix("file:")).exists()


def test_a_merge_leaves_no_working_tables(spark, lake):
    folder = Path(shared_root(spark).removeprefix("file:"))
    rows = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 5), 1.0, dt.date(2024, 1, 1))],
        "district string, event_datetime timestamp, sum_quantity_products double, event_date date",
    )
    before = {p.name for p in folder.iterdir()}
    for _ in range(2):
        lake.merge("demand_forecast", rows, only_changed=False)
    assert not [p for p in folder.iterdir() if p.name not in before and "demand_forecast" in p.name]
    assert lake.read("demand_forecast").count() == 1
