"""Hops per micro-batch: repetition, both outcomes, the batch log."""

import pytest
from pyspark.sql import functions as F

from contract import frames
from contract.queries import _staged_lake
from ledgerlake.sources.shared import shared_path
from ledgerlake.streaming import batches

SF = "/root/testdata/sf0.001"


def test_repeated_batches_replace_themselves(spark, lake):
    rows = frames.sales_raw(spark, SF)
    few, more = rows.filter("customer_id < 100"), rows.filter("customer_id < 900")
    batches.overwrite_batch(lake, "brz_sales_batches", "a", 0, more)
    batches.overwrite_batch(lake, "brz_sales_batches", "a", 1, few)
    batches.overwrite_batch(lake, "brz_sales_batches", "b", 0, few)
    batches.overwrite_batch(lake, "brz_sales_batches", "a", 0, few)  # the repetition has fewer rows
    stored = lake.read("brz_sales_batches")
    n = few.count()
    counts = {(r["stream"], r["batch_id"]): r["count"] for r in stored.groupBy("stream", "batch_id").count().collect()}
    assert counts == {("a", 0): n, ("a", 1): n, ("b", 0): n}
    with pytest.raises(ValueError):
        batches.overwrite_batch(lake, "brz_sales_batches", "a' OR '1", 0, few)


def test_a_repeated_gold_batch_leaves_no_day_of_the_first_try(spark, lake):
    columns = lake.schema_of("gld_sales").fieldNames()
    sales = frames.gold(spark, SF).select(*columns)
    batches.overwrite_batch(lake, "gld_sales_batches", "s", 7, sales.filter("event_date < '1997-01-01'"))
    kept = sales.filter("event_date >= '1998-06-01'")
    batches.overwrite_batch(lake, "gld_sales_batches", "s", 7, kept)
    stored = lake.read("gld_sales_batches")
    assert stored.count() == kept.count()
    assert str(stored.agg(F.min("event_date")).first()[0]) >= "1998-06-01"


def test_every_sale_has_one_outcome_and_files_are_logged(spark):
    lake = _staged_lake(spark, SF)
    directory, checkpoint = shared_path(spark, "events"), shared_path(spark, "ck")
    sales = frames.sales_raw(spark, SF)
    frames.write_events(sales, directory, 7)
    batches.ingest_batches(lake, directory, checkpoint, max_files=3)
    batches.ingest_batches(lake, directory, checkpoint, max_files=3)  # nothing new
    log = lake.read("batch_log").filter("stream = 'ingest'").orderBy("batch_id").collect()
    assert [r["files"] for r in log] == [3, 3, 1] and sum(r["n_rows"] for r in log) == sales.count()
    lake.append("brz_sales", sales.withColumn("latitude", F.when(F.col("customer_id") > 5, F.col("latitude"))))
    batches.place_batches(lake, shared_path(spark, "ck"), max_files=1000)
    placed, rejects = lake.read("slv_sales_batches"), lake.read("slv_rejects")
    outcomes = placed.select("order_id").unionByName(rejects.select("order_id"))
    assert outcomes.count() == outcomes.distinct().count() == sales.count()
    # Sales without a position are rejected as well.
    assert rejects.filter("latitude IS NULL").count() == sales.filter("customer_id <= 5").count()


def test_regions_are_cut_again_only_when_their_snapshot_changes(spark):
    lake = _staged_lake(spark, SF)
    current = batches.CurrentRegions(lake)
    first = current.get()
    assert current.get() is first
    moved = lake.read("slv_neighborhoods").limit(3).withColumn("name", F.lit("Renamed"))
    lake.merge("slv_neighborhoods", moved)
    assert current.get() is not first
    assert current.get().cells.filter("district = 'Renamed'").count() > 0
