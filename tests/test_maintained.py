"""Stored partial results, change feeds and places against computations over all rows."""

import re

import pytest
from pyspark.sql import functions as F

from contract import frames
from ledgerlake.operators.places import with_places
from ledgerlake.plans import dimensions, maintained, views
from ledgerlake.sources.shared import Scratch
from conftest import final_plan, rows

SF = "/root/testdata/sf0.001"
VIEWS = {
    "vw_gld_sales_districts": views.sales_by_district,
    "vw_gld_sales_employees": views.sales_by_employee,
    "vw_gld_customers_districts": views.customers_by_district,
    "vw_gld_best_customers": views.best_customers,
    "vw_gld_best_employees": views.best_employees,
}


def odd_gold(spark, lake):
    """Sales with nulls in every column that the views read, on few days."""
    hole = lambda c, k: F.when(F.col("n") % k != 0, F.col(c)).alias(c)
    day = F.date_add(F.lit("2024-01-28").cast("date"), (F.col("id") % 6).cast("int"))
    base = spark.range(400).select(
        F.col("id").alias("n"), F.concat(F.lit("o"), "id").alias("order_id"),
        F.concat(F.lit("c"), F.col("id") * 7 % 31).alias("customer"),
        F.concat(F.lit("e"), F.col("id") % 5).alias("employee"),
        F.concat(F.lit("d"), F.col("id") % 4).alias("district"),
        (F.col("id") % 9).cast("int").alias("quantity_products"), day.alias("event_date"),
    ).withColumns({"event_year": F.year("event_date"), "event_month": F.month("event_date")})
    holes = {"order_id": 11, "customer": 13, "employee": 17, "district": 19, "quantity_products": 3}
    gold = base.select(*[hole(c, holes[c]) if c in holes else F.col(c) for c in base.columns])
    undated = base.limit(5).withColumns({c: F.lit(None) for c in ("event_date", "event_year", "event_month")})
    gold = gold.unionByName(undated, allowMissingColumns=True).drop("n")
    stored = lake.schema_of("gld_sales")
    return gold.select(*[
        (F.col(f.name) if f.name in gold.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored
    ])


@pytest.mark.parametrize("loads", [1, 3])
def test_maintained_views_equal_views_over_all_sales(spark, lake, loads):
    gold = odd_gold(spark, lake)
    days = ["2024-01-30", "2024-02-01"]
    dated = F.col("event_date")
    if loads == 1:
        lake.append("gld_sales", gold)
        maintained.refresh(lake)
    else:
        lake.append("gld_sales", gold.filter(dated.isNull() | (dated < days[0])))
        maintained.refresh(lake)
        lake.append("gld_sales", gold.filter((dated >= days[0]) & (dated < days[1])))
        maintained.refresh(lake, since=days[0])
        lake.append("gld_sales", gold.filter(dated >= days[1]))
        maintained.refresh(lake, since=days[1])
        # A repeated refresh changes nothing.
        assert maintained.refresh(lake, since=days[1]) == {"day_totals": 0, "day_people": 0}
    for name, view in VIEWS.items():
        assert rows(maintained.maintained_view(lake, name)) == rows(view(lake.read("gld_sales"))), name
    ids = lake.read("people_ids")
    for kind in maintained.PEOPLE:
        numbers = sorted(r["id"] for r in ids.filter(F.col("kind") == kind).collect())
        assert numbers == list(range(1, len(numbers) + 1))


def test_a_refresh_reads_only_the_new_days(spark, lake):
    lake.append("gld_sales", odd_gold(spark, lake))
    new = maintained._since(lake.read("gld_sales"), "2024-02-01")
    plan = final_plan(maintained.day_totals(new))
    assert re.search(r"PartitionFilters: \[\(isnull\(event_date#\d+\) OR \(event_date#\d+ >= 2024-02-01", plan)
    scanned = {f.split("event_date=")[1][:10] for f in new.inputFiles()}
    assert {d for d in scanned if d.startswith("20")} == {"2024-02-01", "2024-02-02"}


def people(spark, rows_):
    return spark.createDataFrame(
        rows_, "customer_id long, name string, phone string, email string, address string"
    )


def test_silver_follows_the_feed(spark, lake):
    first = people(spark, [(1, " Ann ", None, None, "x"), (2, "Bob", None, None, "y"), (None, "Nobody", "", "", "")])
    assert lake.merge("brz_customers", first, feed=True) == 3
    assert dimensions.refresh_silver_from_feed(lake)["slv_customers"] == 3
    assert dimensions.refresh_silver_from_feed(lake)["slv_customers"] == 0
    lake.merge("brz_customers", people(spark, [(1, "Ann", None, None, "x"), (2, "Rob", None, None, "y")]), feed=True)
    lake.merge("brz_customers", people(spark, [(2, "Bert ", None, None, "z"), (3, "Cid", None, None, None)]), feed=True)
    feed = lake.read("brz_customers_feed")
    seen = rows(feed, "version", "customer_id", "change")
    assert [r for r in seen if r[0] > 1] == [(2, 1, "update"), (2, 2, "update"), (3, 2, "update"), (3, 3, "insert")]
    pruned = final_plan(lake.changes_since("brz_customers", 2))
    assert re.search(r"PartitionFilters: \[isnotnull\(version#\d+L?\), \(version#\d+L? > 2\)", pruned)
    # Ann is as before once trimmed, so only the two others are written.
    assert dimensions.refresh_silver_from_feed(lake)["slv_customers"] == 2
    kept = rows(lake.read("slv_customers").filter("customer_id IS NOT NULL"))
    whole = dimensions.clean_people(lake.read("brz_customers"), "customer_id").filter("customer_id IS NOT NULL")
    assert kept == rows(whole)


def test_areas_follow_their_donors(spark, lake):
    staged = frames.staged_neighborhoods(spark, SF).withColumn("OBJECTID", F.col("OBJECTID") + 330)
    lake.merge("brz_neighborhoods", staged, feed=True)
    dimensions.refresh_silver_from_feed(lake)
    renamed = staged.withColumn("NOMBRE", F.concat(F.lit("New "), "NOMBRE"))
    lake.merge("brz_neighborhoods", renamed.filter("OBJECTID IN (339, 345)"), feed=True)
    assert dimensions.refresh_silver_from_feed(lake)["slv_neighborhoods"] == 3  # 340 takes the name of 339
    lake.merge("brz_neighborhoods", renamed.filter("OBJECTID = 342"), feed=True)
    assert dimensions.refresh_silver_from_feed(lake)["slv_neighborhoods"] == 0  # it keeps that of its donor
    whole = dimensions.clean_neighborhoods(lake.read("brz_neighborhoods"))
    assert rows(lake.read("slv_neighborhoods")) == rows(whole)


def test_places_are_those_of_a_whole_sort(spark):
    data = spark.range(5000).select((F.col("id") * 7919 % 613).alias("a"), F.col("id").alias("b"))
    found = with_places(data.repartition(9), F.desc("a"), "b")
    ordered = sorted(((r["a"], r["b"]) for r in data.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r["a"], r["b"]) for r in found.orderBy("place").collect()] == ordered
    assert sorted(r["place"] for r in found.collect()) == list(range(1, 5001))
    assert with_places(data.limit(0), "b").collect() == []


def test_bitmaps_are_built_where_their_numbers_meet(spark, lake):
    lake.append("gld_sales", odd_gold(spark, lake))
    gold = lake.read("gld_sales")
    maintained.refresh(lake)
    plan = final_plan(maintained.day_people(maintained.people_of_days(gold), lake.read("people_ids")))
    # No exchange carries bitmaps: the numbers are exchanged, then set.
    assert re.search(r"Aggregate\(.*bitmap_construct_agg.*\n.*Aggregate\(.*partial_bitmap_construct_agg", plan)


def test_people_of_a_district_are_neighbours(spark, lake):
    data = [("customer", f"c{i:02d}", f"d{i % 3}") for i in range(30)] + [("customer", "c00", "d2"), ("employee", "e", None)]
    maintained.number_people(lake, spark.createDataFrame(data, "kind string, name string, district string"))
    ids = {r["name"]: r["id"] for r in lake.read("people_ids").filter("kind = 'customer'").collect()}
    expected = sorted({n for k, n, d in data if k == "customer"}, key=lambda n: (int(n[1:]) % 3, n))
    assert sorted(ids, key=ids.get) == expected and sorted(ids.values()) == list(range(1, 31))


def test_a_computed_source_is_not_written_again(spark, lake, monkeypatch):
    lake.append("gld_sales", odd_gold(spark, lake))
    labels = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, label: (labels.append(label), write(self, df, label))[1])
    maintained.refresh(lake)
    assert "day-totals" in labels and not [l for l in labels if l.startswith(("merge-day", "merged-day"))]
