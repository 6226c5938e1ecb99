"""The analytic views kept up to date: stored partial results instead of all sales.

Three tables are kept by :func:`refresh`, which reads only the gold days it is told to:

* ``day_totals``: sales and products per day and district, employee and customer;
* ``month_totals``: the same by month, added up from the days of the touched months;
* ``day_people``: per day and district the set of customers and of employees as bitmaps.

Sets don't add up as totals do: who buys on two days counts once in the month.  People get
dense numbers (``people_ids``), a set is a bitmap of 32,768 numbers per bucket, the months
unite bitmaps, and counting bits gives exact distinct counts.  All merges go by keys
and replace whole rows, so a refresh that was ended or is run twice gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlake.operators.joins import equal_keys, reference_join
from ledgerlake.operators.places import with_places
from ledgerlake.plans.views import VIEW_SQL
from ledgerlake.sources.lake import Lake
from ledgerlake.sources.shared import Scratch

MEASURES = ["district", "employee", "customer"]
PEOPLE = ["customer", "employee"]
_DAY = ["event_date", "event_year", "event_month"]


def _since(rows: DataFrame, since) -> DataFrame:
    day = F.col("event_date")
    return rows if since is None else rows.filter(day.isNull() | (day >= F.lit(since).cast("date")))


def _by_name(columns: list[str], kind: str, name: str):
    """One row per named column: (kind, name)."""
    return F.inline(F.array(*[F.struct(F.lit(c).alias(kind), F.col(c).alias(name)) for c in columns]))


def _with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.trunc("event_date", "month"))


def day_totals(gold: DataFrame) -> DataFrame:
    """Sales and products per day and entity, for all measures in one scan."""
    named = gold.select(*_DAY, "order_id", "quantity_products", _by_name(MEASURES, "measure", "entity"))
    return _with_month(
        named.groupBy("measure", "entity", *_DAY).agg(
            F.count("order_id").alias("sales"), F.sum("quantity_products").alias("products")
        )
    )


def refresh_totals(lake: Lake, gold: DataFrame) -> int:
    """Merge the totals of the given days, then those of their months."""
    with Scratch(lake.spark) as scratch:
        fresh = scratch.materialize(day_totals(gold), "day-totals")
        written = lake.merge("day_totals", fresh, computed=True)
        # Calendar months: a bounded list, which prunes the partitions.
        months = [row[0] for row in fresh.select("month").distinct().collect()]
        stored = lake.read("day_totals")
        touched = F.col("month").isin([m for m in months if m is not None])
        days = stored.filter(touched | F.col("month").isNull() if None in months else touched)
        keys = ["measure", "entity", "event_year", "event_month"]
        monthly = days.groupBy(*keys).agg(F.sum("sales").alias("sales"), F.sum("products").alias("products"))
        lake.merge("month_totals", scratch.materialize(monthly, "month-totals"), computed=True)
    return written


def number_people(lake: Lake, people: DataFrame) -> None:
    """Give new people (kind, name, district) the next dense numbers of their kind.

    People of a district get neighbouring numbers: where they mostly buy or sell in one district,
    its bitmaps have few buckets.  Any numbering gives the same counts.
    """
    known = lake.read("people_ids")
    with Scratch(lake.spark) as scratch:
        homes = people.groupBy("kind", "name").agg(F.min("district").alias("district"))
        new = scratch.materialize(
            reference_join(homes, known.select("kind", "name"), equal_keys(["kind", "name"]), "left_anti"), "people"
        )
        for kind in PEOPLE:
            last = known.filter(F.col("kind") == kind).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            placed = with_places(new.filter(F.col("kind") == kind), "district", "name", name="id")
            numbered = scratch.materialize(placed.withColumn("id", F.col("id") + last), f"ids-{kind}")
            lake.append("people_ids", numbered.select("kind", "name", "id"))


def people_of_days(gold: DataFrame) -> DataFrame:
    """The people of each day and district, each once."""
    return gold.select("district", *_DAY, _by_name(PEOPLE, "kind", "name")).filter("name IS NOT NULL").distinct()


def day_people(people: DataFrame, ids: DataFrame) -> DataFrame:
    """Bitmaps of the :func:`people_of_days`.

    Numbers travel to the task of their bitmap and are set there: bitmaps of 4 KB begun in
    every task would travel instead, most of them with a single person.
    """
    keys = ["kind", "district", *_DAY, "bucket"]
    joined = reference_join(people, ids, equal_keys(["kind", "name"])).select(
        "fact.kind", "district", *_DAY, F.bitmap_bucket_number("id").alias("bucket"),
        F.bitmap_bit_position("id").alias("position"),
    )
    met = joined.repartition(*keys)
    return _with_month(met.groupBy(*keys).agg(F.bitmap_construct_agg("position").alias("bits")))


def refresh_people(lake: Lake, gold: DataFrame) -> int:
    """Number new people and merge the bitmaps of the given days."""
    with Scratch(lake.spark) as scratch:
        people = scratch.materialize(people_of_days(gold), "day-people")
        number_people(lake, people.select("kind", "name", "district"))
        bitmaps = scratch.materialize(day_people(people, lake.read("people_ids")), "bitmaps")
        return lake.merge("day_people", bitmaps, computed=True)


def refresh(lake: Lake, since=None) -> dict[str, int]:
    """Bring the stored partial results up to date, reading gold days from ``since`` on.

    The day filter prunes the partitions of gold; sales without a day are always read.
    Returns the written rows per table.
    """
    gold = _since(lake.read("gld_sales"), since)
    return {"day_totals": refresh_totals(lake, gold), "day_people": refresh_people(lake, gold)}


def distinct_people(lake: Lake) -> DataFrame:
    """Exact distinct customers and employees per month and district, from the bitmaps."""
    months = ["event_year", "event_month", "district"]
    united = lake.read("day_people").groupBy("kind", *months, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits = F.bitmap_count("bits")
    return united.groupBy(*months).agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, bits)), F.lit(0)).alias(f"{k}s") for k in PEOPLE]
    )


def _daily(lake: Lake, measure: str) -> DataFrame:
    return (
        lake.read("day_totals").filter(F.col("measure") == measure)
        .groupBy("event_date", F.col("entity").alias(measure))
        .agg(F.sum("sales").alias("sales"), F.sum("products").alias("products"))
    )


def _monthly(lake: Lake, measure: str) -> DataFrame:
    rows = lake.read("month_totals").filter(F.col("measure") == measure)
    return rows.select("event_year", "event_month", F.col("entity").alias(measure), "products")


def _monthly_districts(lake: Lake) -> DataFrame:
    keys = ["event_year", "event_month", "district"]
    counts = distinct_people(lake)
    joined = reference_join(_monthly(lake, "district"), counts, equal_keys(keys, null_safe=True), "left")
    zero = [F.coalesce(F.col(f"side.{c}"), F.lit(0)).alias(c) for c in ("customers", "employees")]
    return joined.select(*[F.col(f"fact.{c}") for c in keys], *zero, F.col("fact.products"))


_SOURCES = {
    "vw_gld_sales_districts": lambda lake: _daily(lake, "district"),
    "vw_gld_sales_employees": lambda lake: _daily(lake, "employee"),
    "vw_gld_customers_districts": _monthly_districts,
    "vw_gld_best_customers": lambda lake: _monthly(lake, "customer"),
    "vw_gld_best_employees": lambda lake: _monthly(lake, "employee"),
}


def maintained_view(lake: Lake, view: str) -> DataFrame:
    """One of the five views over the stored partial results, without reading any sale."""
    text = VIEW_SQL[view].format(totals="SELECT * FROM {totals}")
    return lake.spark.sql(text, totals=_SOURCES[view](lake))
