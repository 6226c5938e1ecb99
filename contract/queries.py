"""Contract queries: one per operator, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from contract import frames
from contract.frames import portable
from ledgerlake.functions.geometry import (
    edges_bbox,
    geojson_rings,
    point_in_geojson,
    ring_edges,
    wkb_to_geojson,
)
from ledgerlake.functions.text import trim_strings
from ledgerlake.functions.times import hour_text, parse_hour_text
from ledgerlake.functions.vectors import first_place_of, vector_entry, vector_size
from ledgerlake.operators import series
from ledgerlake.operators.cleanse import copy_attributes, dedupe_by_key, latest_per_key
from ledgerlake.operators.spatial import RegionIndex
from ledgerlake.operators.upsert import count_changes, upsert
from ledgerlake.operators.places import with_places
from ledgerlake.plans import dimensions, forecast, maintained, maintained_features, training, views
from ledgerlake.plans.sales import enrich_dates, region_index, to_gold, to_silver, unreadable_dates
from ledgerlake.sources import models
from ledgerlake.sources.shared import materialize, shared_path
from ledgerlake.streaming import batches, hops

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-25 12:00:00"
CUT_OFF, LAST_DAY, TODAY = "2024-01-20", "2024-01-23", "2024-01-25"


def contract(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def naive(df: DataFrame) -> DataFrame:
    """Timestamps as wall-clock values, so that results do not depend on a zone."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if f.dataType.simpleString() == "timestamp"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- scans, projections, clean-up ----------------------------------------------


@contract(
    "scan_project_filter",
    """select o_orderkey, o_custkey, cast(o_orderdate as date) as order_day,
              cast(floor(o_totalprice) as bigint) as price, 'web' as channel
       from orders where o_orderdate >= timestamp '1997-01-01' and o_totalprice > 1000
         and o_orderstatus = 'F'""",
)
def scan_project_filter(spark, sf_dir):
    orders = frames.table(spark, sf_dir, "orders")
    finished = F.col("o_orderstatus") == "F"
    recent = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    return orders.filter(recent & (F.col("o_totalprice") > 1000) & finished).select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_day"),
        F.floor("o_totalprice").alias("price"), F.lit("web").alias("channel"),
    )


@contract(
    "rename_drop",
    """select c_custkey as customer_id, c_name as customer, c_nationkey as nation_id,
              c_mktsegment from customer""",
)
def rename_drop(spark, sf_dir):
    customer = frames.table(spark, sf_dir, "customer")
    return (
        customer.withColumnRenamed("c_custkey", "customer_id")
        .withColumnsRenamed({"c_name": "customer", "c_nationkey": "nation_id"})
        .drop("c_acctbal")
    )


@contract("trim_strings", "select c_custkey, c_name, c_mktsegment, c_acctbal from customer")
def trim_all_strings(spark, sf_dir):
    padded = frames.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("  "), "c_name").alias("c_name"),
        F.concat(F.lit(" "), "c_mktsegment", F.lit("   ")).alias("c_mktsegment"), "c_acctbal",
    )
    return trim_strings(padded)


@contract(
    "dedupe_by_key",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
              l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
       from (select *, row_number() over (partition by l_orderkey order by l_linenumber,
                 l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                 l_returnflag, l_linestatus, l_shipdate) as place from lineitem)
       where place = 1""",
)
def dedupe_lines(spark, sf_dir):
    return dedupe_by_key(frames.table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"])


@contract("distinct_keys", "select distinct event_type, user_id from events")
def distinct_keys(spark, sf_dir):
    return frames.table(spark, sf_dir, "events").select("event_type", "user_id").distinct()


@contract("row_count", "select count(*) as n_rows from lineitem")
def row_count(spark, sf_dir):
    return frames.table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))


@contract(
    "patch_rows",
    """select t.s_suppkey, t.s_nationkey, t.s_acctbal,
              case when d.s_suppkey is null then t.s_name else d.s_name end as s_name
       from (select *, case s_suppkey when 4 then 3 when 9 then 7 when 5 then -1 end as donor
             from supplier) t
       left join supplier d on d.s_suppkey = t.donor""",
)
def patch_rows(spark, sf_dir):
    supplier = frames.table(spark, sf_dir, "supplier")
    return copy_attributes(supplier, "s_suppkey", {3: 4, 7: 9, -1: 5}, ["s_name"])


@contract(
    "event_date_parts",
    """select event_id, date_trunc('second', ts) as event_date,
              strftime(ts, '%d%m%Y') as partition_date,
              cast(day(ts) as int) as event_day, cast(hour(ts) as int) as event_hour,
              cast(minute(ts) as int) as event_minute, cast(month(ts) as int) as event_month,
              cast(second(ts) as int) as event_second, cast(year(ts) as int) as event_year,
              cast(dayofweek(ts) + 1 as int) as event_weekday
       from events""",
)
def event_date_parts(spark, sf_dir):
    events = frames.table(spark, sf_dir, "events")
    texts = events.select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("date"))
    parts = enrich_dates(texts).withColumn("event_weekday", F.dayofweek("event_date"))
    return naive(parts)


@contract(
    "unreadable_dates",
    "select order_id from (" + portable(frames.SALES_SQL) + ") where quantity_products > 40",
)
def unreadable(spark, sf_dir):
    sales = frames.sales_raw(spark, sf_dir)
    spoilt = F.when(F.col("quantity_products") > 40, F.concat(F.lit("31/02"), F.substr("date", F.lit(6))))
    return unreadable_dates(sales.withColumn("date", F.coalesce(spoilt, "date"))).select("order_id")


@contract(
    "hour_labels",
    """select event_id, strftime(ts, '%Y-%m-%d %H') as hour_label,
              date_trunc('hour', ts) as event_datetime from events""",
)
def hour_labels(spark, sf_dir):
    events = frames.table(spark, sf_dir, "events")
    label = hour_text(F.to_date("ts"), F.hour("ts"))
    labelled = events.select("event_id", label.alias("hour_label"))
    return naive(labelled.withColumn("event_datetime", parse_hour_text(F.col("hour_label"))))


# -- upserts --------------------------------------------------------------------

_STORED = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders"
_OLD_ORDERS = f"({_STORED} where o_orderdate < timestamp '2000-01-01')"
_NEW_ORDERS = """(select o_orderkey, o_custkey,
       case when o_orderstatus = 'P' then 'F' else o_orderstatus end as o_orderstatus, o_totalprice
  from orders where o_orderdate >= timestamp '1999-01-01')"""


def _order_slices(spark, sf_dir):
    orders = frames.table(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    day = F.col("o_orderdate").cast("date")
    settled = F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus"))
    stored = orders.filter(day < F.lit("2000-01-01").cast("date")).select(*columns)
    incoming = (
        orders.filter(day >= F.lit("1999-01-01").cast("date"))
        .withColumn("o_orderstatus", settled).select(*columns)
    )
    return stored, incoming


_UPSERTED = f"""select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey,
         case when s.o_orderkey is null then t.o_custkey else s.o_custkey end as o_custkey,
         case when s.o_orderkey is null then t.o_orderstatus else s.o_orderstatus end as o_orderstatus,
         case when s.o_orderkey is null then t.o_totalprice else s.o_totalprice end as o_totalprice
  from {_OLD_ORDERS} t full join {_NEW_ORDERS} s on t.o_orderkey = s.o_orderkey"""


@contract("upsert_unconditional", _UPSERTED)
def upsert_unconditional(spark, sf_dir):
    return upsert(*_order_slices(spark, sf_dir), ["o_orderkey"])


@contract(
    "upsert_classify",
    f"""select case when s.o_orderkey is null then 'target_only'
               when t.o_orderkey is null then 'insert'
               when t.o_custkey is distinct from s.o_custkey
                 or t.o_orderstatus is distinct from s.o_orderstatus
                 or t.o_totalprice is distinct from s.o_totalprice then 'update'
               else 'unchanged' end as change, count(*) as n_rows
        from {_OLD_ORDERS} t full join {_NEW_ORDERS} s on t.o_orderkey = s.o_orderkey group by 1""",
)
def upsert_classify(spark, sf_dir):
    return count_changes(*_order_slices(spark, sf_dir), ["o_orderkey"])


@contract(
    "upsert_change_detect",
    """select c_custkey as customer_id, c_name as name, cast(null as varchar) as phone,
              case when c_acctbal < 0 then 'blocked' end as email, c_mktsegment as address
       from customer""",
)
def upsert_change_detect(spark, sf_dir):
    """Two merges into a stored dimension; the second changes some rows and adds others."""
    people = frames.customers(spark, sf_dir)
    balance = frames.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), "c_acctbal"
    )
    blocked = F.when(F.col("c_acctbal") < 0, "blocked")
    marked = people.join(balance, "customer_id").withColumn("email", blocked).drop("c_acctbal")
    lake = frames.new_lake(spark)
    lake.merge("brz_customers", people.filter("address <> 'MACHINERY'"))
    lake.merge("brz_customers", marked)
    return lake.read("brz_customers")


# -- geometry and location --------------------------------------------------------


@contract(
    "decode_geometry",
    f"""select id, {frames.geojson_sql()} as geojson, 1 as rings, 6 as corners,
               x0 as min_x, y0 as min_y, x0 + size as max_x, y0 + size as max_y
        from ({portable(frames.PARCELS_SQL)})""",
)
def decode_geometry(spark, sf_dir):
    shapes = frames.wkb_shapes(spark, sf_dir, frames.PARCELS_SQL, "supplier")
    decoded = shapes.select("id", wkb_to_geojson(F.col("geometry")).alias("geojson"))
    rings = geojson_rings(F.col("geojson"))
    # The degenerate closing edge of a closed ring makes edges and corners equal in number.
    return (
        decoded.withColumn("rings", F.size(rings))
        .withColumn("edges", ring_edges(rings))
        .withColumn("box", edges_bbox(F.col("edges")))
        .select("id", "geojson", "rings", F.size("edges").alias("corners"), "box.*")
    )


@contract(
    "point_in_polygon",
    f"""with shapes as ({portable(frames.PARCELS_SQL)}),
             edges as ({frames.edges_sql('shapes')}),
             spots as (select id, x0 + size * (id % 16) / 16e0 + size / 32e0 as longitude,
                              y0 + size * (id % 7) / 8e0 + size / 32e0 as latitude from shapes),
             crossed as (select s.id, count(*) as n from spots s join edges e using (id)
                         where (ay > latitude) <> (b_y > latitude)
                           and longitude < (bx - ax) * (latitude - ay)
                               / (case when b_y = ay then 1e0 else b_y - ay end) + ax
                         group by s.id)
        select s.id, coalesce(n, 0) % 2 = 1 as inside from spots s left join crossed using (id)""",
)
def point_in_polygon(spark, sf_dir):
    """The containment test as a column: one own point per parcel."""
    shapes = spark.sql(frames.PARCELS_SQL, **frames.tables(spark, sf_dir, "supplier"))
    parcels = frames.pentagons(spark, sf_dir, frames.PARCELS_SQL, "supplier")
    x0, y0, size, step = F.col("x0"), F.col("y0"), F.col("size"), F.col("id")
    spots = shapes.select(
        "id",
        (x0 + size * (step % 16) / 16 + size / 32).alias("longitude"),
        (y0 + size * (step % 7) / 8 + size / 32).alias("latitude"),
    )
    inside = point_in_geojson(F.col("latitude"), F.col("longitude"), F.col("geojson"))
    return parcels.join(spots, "id").select("id", inside.alias("inside"))


_DISTRICT_MATCHES = f"""
with shapes as ({portable(frames.DISTRICTS_SQL)}),
edges as ({frames.edges_sql('shapes')}),
points as ({portable(frames.POINTS_SQL)}),
matches as ({frames.containment_sql('points', 'o_orderkey')})
"""


@contract("spatial_join", _DISTRICT_MATCHES + "select o_orderkey, district from matches")
def spatial_join(spark, sf_dir):
    districts = frames.pentagons(spark, sf_dir, frames.DISTRICTS_SQL, "nation")
    placed = RegionIndex(districts).assign(frames.points(spark, sf_dir))
    return placed.select("o_orderkey", "district")


@contract(
    "spatial_unmatched",
    _DISTRICT_MATCHES
    + "select o_orderkey from points where o_orderkey not in (select o_orderkey from matches)",
)
def spatial_unmatched(spark, sf_dir):
    districts = frames.pentagons(spark, sf_dir, frames.DISTRICTS_SQL, "nation")
    return RegionIndex(districts).unmatched(frames.points(spark, sf_dir)).select("o_orderkey")


_PARCEL_MATCHES = f"""
with shapes as ({portable(frames.PARCELS_SQL)}),
edges as ({frames.edges_sql('shapes')}),
points as ({portable(frames.POINTS_SQL)}),
matches as ({frames.containment_sql('points', 'o_orderkey')})
"""


@contract("spatial_join_overlaps", _PARCEL_MATCHES + "select o_orderkey, id from matches")
def spatial_join_overlaps(spark, sf_dir):
    """Overlapping regions of several sizes, through the shuffled form of the join."""
    parcels = frames.pentagons(spark, sf_dir, frames.PARCELS_SQL, "supplier")
    placed = RegionIndex(parcels).assign(frames.points(spark, sf_dir), broadcast_bytes=0)
    return placed.select("o_orderkey", "id")


@contract(
    "spatial_unmatched_overlaps",
    _PARCEL_MATCHES
    + "select o_orderkey from points where o_orderkey not in (select o_orderkey from matches)",
)
def spatial_unmatched_overlaps(spark, sf_dir):
    parcels = frames.pentagons(spark, sf_dir, frames.PARCELS_SQL, "supplier")
    return RegionIndex(parcels).unmatched(frames.points(spark, sf_dir)).select("o_orderkey")


# -- sales: dates, location, people ------------------------------------------------

_SALES = f"sales_raw as ({portable(frames.SALES_SQL)})"
_PLACED = f"""
shapes as ({portable(frames.DISTRICTS_SQL)}),
edges as ({frames.edges_sql('shapes')}),
matches as ({frames.containment_sql('sales_raw', 'order_id')}),
dated as (select *, strptime(date, '%d/%m/%Y %H:%M:%S') as moment from sales_raw),
silver as (
  select order_id, customer_id, employee_id, latitude, longitude, quantity_products, district,
         'Area ' || cast(id as varchar) as neighborhood, moment as event_date,
         strftime(moment, '%d%m%Y') as partition_date, cast(day(moment) as int) as event_day,
         cast(hour(moment) as int) as event_hour, cast(minute(moment) as int) as event_minute,
         cast(month(moment) as int) as event_month, cast(second(moment) as int) as event_second,
         cast(year(moment) as int) as event_year
  from dated join matches using (order_id))
"""
_NAMED = """
select order_id, s_name as employee, c_name as customer, latitude, longitude, district,
       quantity_products, partition_date, event_hour, event_day, event_month, event_year,
       cast(event_date as date) as event_date
from {source} join customer on customer_id = c_custkey join supplier on employee_id = s_suppkey
"""


@contract(
    "gold_star_join",
    f"with {_SALES}, dated as (select *, strptime(date, '%d/%m/%Y %H:%M:%S') as moment from sales_raw), "
    "silver as (select * exclude (date), 'everywhere' as district, moment as event_date, "
    "strftime(moment, '%d%m%Y') as partition_date, cast(hour(moment) as int) as event_hour, "
    "cast(day(moment) as int) as event_day, cast(month(moment) as int) as event_month, "
    "cast(year(moment) as int) as event_year from dated)" + _NAMED.format(source="silver"),
)
def gold_star_join(spark, sf_dir):
    dated = enrich_dates(frames.sales_raw(spark, sf_dir))
    silver = dated.withColumn("district", F.lit("everywhere"))
    return to_gold(silver, frames.customers(spark, sf_dir), frames.employees(spark, sf_dir))


def _staged_lake(spark, sf_dir):
    """A lake with silver dimensions, merged from staged files through bronze."""
    lake = frames.new_lake(spark)
    staged = {
        "brz_customers": frames.customers(spark, sf_dir),
        "brz_employees": frames.employees(spark, sf_dir),
        "brz_neighborhoods": frames.staged_neighborhoods(spark, sf_dir),
    }
    for name, rows in staged.items():
        directory = shared_path(spark, f"staged-{name}")
        rows.write.parquet(directory)
        dimensions.load_staged(lake, name, directory)
    dimensions.refresh_silver(lake)
    return lake


def _event_files(spark, sf_dir, files=15):
    directory = shared_path(spark, "event-files")
    frames.write_events(frames.sales_raw(spark, sf_dir), directory, files)
    return directory


@contract("stream_bronze", f"with {_SALES} select * from sales_raw")
def stream_bronze(spark, sf_dir):
    lake = frames.new_lake(spark)
    hops.ingest_sales(lake, _event_files(spark, sf_dir), shared_path(spark, "ck"), writers=1)
    return lake.read("brz_sales")


@contract("stream_silver", f"with {_SALES}, {_PLACED} select * from silver")
def stream_silver(spark, sf_dir):
    lake = _staged_lake(spark, sf_dir)
    hops.ingest_sales(lake, _event_files(spark, sf_dir), shared_path(spark, "ck"), writers=1)
    hops.refine_sales(lake, shared_path(spark, "ck"), max_files=200, writers=1)
    return naive(lake.read("slv_sales"))


@contract("stream_gold", f"with {_SALES}, {_PLACED}" + _NAMED.format(source="silver"))
def stream_gold(spark, sf_dir):
    lake = _staged_lake(spark, sf_dir)
    hops.ingest_sales(lake, _event_files(spark, sf_dir), shared_path(spark, "ck"), writers=1)
    hops.refine_sales(lake, shared_path(spark, "ck"), max_files=200, writers=1)
    hops.publish_sales(lake, shared_path(spark, "ck"), max_files=200, writers=1)
    return lake.read("gld_sales")


@contract(
    "stream_resume",
    f"with {_SALES} select order_id, 1 as copies from sales_raw",
)
def stream_resume(spark, sf_dir):
    """Three runs on one checkpoint, new files before the second: every sale arrives once."""
    lake = frames.new_lake(spark)
    sales = frames.sales_raw(spark, sf_dir)
    checkpoint, directory = shared_path(spark, "ck"), shared_path(spark, "event-files")
    for batch in (sales.filter("customer_id < 800"), sales.filter("customer_id >= 800")):
        frames.write_events(batch, directory, 12)
        hops.ingest_sales(lake, directory, checkpoint, writers=1)
    hops.ingest_sales(lake, directory, checkpoint, writers=1)
    counted = lake.read("brz_sales").groupBy("order_id")
    return counted.agg(F.count(F.lit(1)).cast("int").alias("copies"))


@contract(
    "stream_batches",
    """select b as batch_id, f as files, (select count(*) from events) as all_rows, true as complete
       from (values (0::bigint, 10::bigint), (1, 10), (2, 5)) x(b, f)""",
)
def stream_batches(spark, sf_dir):
    """25 files, ten a batch: the log names three batches and has the rows of each."""
    lake = frames.new_lake(spark)
    batches.ingest_batches(lake, _event_files(spark, sf_dir, 25), shared_path(spark, "ck"), max_files=10)
    stored = lake.read("brz_sales_batches").groupBy("stream", "batch_id").agg(F.count(F.lit(1)).alias("n_stored"))
    total = lake.read("batch_log").agg(F.sum("n_rows")).first()[0]
    return lake.read("batch_log").join(F.broadcast(stored), ["stream", "batch_id"], "left").select(
        "batch_id", "files", F.lit(total).cast("bigint").alias("all_rows"),
        (F.col("n_rows") == F.col("n_stored")).alias("complete"),
    )


@contract(
    "stream_rejects",
    f"""with {_SALES}, {_PLACED}
        select order_id, district, event_date from silver union all
        select order_id, null, moment from dated where order_id not in (select order_id from matches)""",
)
def stream_rejects(spark, sf_dir):
    """Placed and rejected sales of one stream, with a batch that is handed over twice."""
    lake = _staged_lake(spark, sf_dir)
    lake.append("brz_sales", frames.sales_raw(spark, sf_dir))
    batches.place_batches(lake, shared_path(spark, "ck"), max_files=1_000_000)
    regions = batches.CurrentRegions(lake).get()
    batches.place_batch(lake, regions, "placing", 0, lake.read("brz_sales"))
    placed = lake.read("slv_sales_batches").select("order_id", "district", "event_date")
    rejected = lake.read("slv_rejects").withColumn("district", F.lit(None).cast("string"))
    return naive(placed.unionByName(rejected.select("order_id", "district", "event_date")))


@contract(
    "stream_current_names",
    f"with {_SALES}, {_PLACED}, "
    "named as (" + _NAMED.format(source="silver") + ") select * replace "
    "(customer || case when cast(order_id as bigint) % 2 = 1 then ' II' else '' end as customer) from named",
)
def stream_current_names(spark, sf_dir):
    """Customers are renamed between two batches of one run; each batch has the names of its time."""
    lake = _staged_lake(spark, sf_dir)
    silver = to_silver(frames.sales_raw(spark, sf_dir), region_index(lake.read("slv_neighborhoods")))
    odd = F.col("order_id").cast("bigint") % 2 == 1
    lake.append("slv_sales", silver.filter(~odd))
    first = len(lake.read("slv_sales").inputFiles())
    lake.append("slv_sales", silver.filter(odd))
    asked = []

    def people(lake):
        asked.append(True)
        if len(asked) == 2:
            renamed = lake.read("slv_customers").withColumn("name", F.concat("name", F.lit(" II")))
            lake.merge("slv_customers", renamed)
        return batches.current_people(lake)

    batches.publish_batches(lake, shared_path(spark, "ck"), max_files=first, people=people)
    return lake.read("gld_sales_batches").select(*lake.schema_of("gld_sales").fieldNames())


@contract(
    "silver_from_feed",
    """select c_custkey as customer_id, c_name as name, cast(null as varchar) as phone,
              case when c_acctbal < 0 then 'blocked' end as email,
              case when c_nationkey < 5 then 'moved' else c_mktsegment end as address
       from customer""",
)
def silver_from_feed(spark, sf_dir):
    """Three merges into bronze; silver reads only what the change feed holds since its last refresh."""
    people = frames.customers(spark, sf_dir)
    about = frames.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), "c_acctbal", "c_nationkey"
    )
    blocked = F.when(F.col("c_acctbal") < 0, "blocked")
    second = people.join(about, "customer_id").withColumn("email", blocked)
    third = second.filter("c_nationkey < 5").withColumn("address", F.lit("  moved "))
    lake = frames.new_lake(spark)
    lake.merge("brz_customers", people.filter("address <> 'MACHINERY'"), feed=True)
    dimensions.refresh_silver_from_feed(lake)
    lake.merge("brz_customers", second.select(*people.columns), feed=True)
    lake.merge("brz_customers", third.select(*people.columns), feed=True)
    dimensions.refresh_silver_from_feed(lake)
    return lake.read("slv_customers")


# -- gold tables and views -----------------------------------------------------------

_GOLD = f"gold as ({portable(frames.GOLD_SQL)})"


def _pct(part: str, whole: str) -> str:
    """Percentage with two digits, halves up, in integer arithmetic."""
    return (
        f"cast((cast({part} as hugeint) * 20000 + cast({whole} as hugeint)) "
        f"// (2 * cast({whole} as hugeint)) as double) / 100"
    )


def _step(value: str, entity: str) -> str:
    return (
        f"cast({value} - lag({value}, 1, {value}) over "
        f"(partition by {entity} order by event_year, event_month) as bigint)"
    )


_DISTRICT_VIEW = f"""
with {_GOLD}, daily as (
  select event_date, district, count(order_id) n, cast(sum(quantity_products) as bigint) q
  from gold group by all)
select event_date, district, n as total_sales_per_day,
       cast(dense_rank() over (partition by event_date order by n desc) as int) as sales_rank,
       {_pct('n', 'sum(n) over (partition by event_date)')} as percent_total_sales_per_day,
       q as total_products_sold_per_day,
       {_pct('q', 'sum(q) over (partition by event_date)')} as percent_products_sold_per_day
from daily"""

_EMPLOYEE_VIEW = f"""
with {_GOLD}, daily as (
  select event_date, employee, count(order_id) n, cast(sum(quantity_products) as bigint) q
  from gold group by all)
select event_date, employee, {_pct('q', 'n')} as employee_effectiveness,
       cast(dense_rank() over (partition by event_date order by q / n desc) as int) as effectiveness_rank,
       n as total_sales_per_day,
       cast(dense_rank() over (partition by event_date order by n desc) as int) as sales_rank,
       {_pct('n', 'sum(n) over (partition by event_date)')} as percent_total_sales_per_day,
       q as total_products_sold_per_day,
       {_pct('q', 'sum(q) over (partition by event_date)')} as percent_products_sold_per_day
from daily"""

_MONTH = "over (partition by event_year, event_month)"
_CUSTOMER_DISTRICT_VIEW = f"""
with {_GOLD}, monthly as (
  select event_year, event_month, district, count(distinct customer) c, count(distinct employee) e,
         cast(sum(quantity_products) as bigint) q
  from gold group by all)
select event_year, event_month, district, c as total_customers_per_district,
       {_pct('c', f'sum(c) {_MONTH}')} as percent_total_customers_per_district,
       {_step('c', 'district')} as difference_in_customers_from_last_month,
       e as total_employees_per_district,
       {_pct('e', f'sum(e) {_MONTH}')} as percent_total_employees_per_district,
       {_step('e', 'district')} as difference_in_employees_from_last_month,
       round(c / e, 0) as employees_per_customer_ratio,
       q as total_products_sold,
       {_pct('q', f'sum(q) {_MONTH}')} as percent_total_products_sold,
       {_step('q', 'district')} as difference_in_products_sold_from_last_month
from monthly"""


def _best_view(who: str, rank: str, verb: str) -> str:
    return f"""
with {_GOLD}, monthly as (
  select event_year, event_month, {who}, cast(sum(quantity_products) as bigint) q
  from gold group by all)
select event_year, event_month, {who}, q as total_products_{verb},
       cast(dense_rank() over (partition by event_year, event_month order by q desc) as int) as {rank},
       {_pct('q', f'sum(q) {_MONTH}')} as percent_total_products_{verb},
       {_step('q', who)} as difference_in_products_{verb}_from_last_month
from monthly"""


_BEST_CUSTOMERS = _best_view("customer", "best_customer_rank", "bought")


@contract("view_sales_districts", _DISTRICT_VIEW)
def view_sales_districts(spark, sf_dir):
    return views.sales_by_district(frames.gold(spark, sf_dir))


@contract("view_sales_employees", _EMPLOYEE_VIEW)
def view_sales_employees(spark, sf_dir):
    return views.sales_by_employee(frames.gold(spark, sf_dir))


@contract("view_customers_districts", _CUSTOMER_DISTRICT_VIEW)
def view_customers_districts(spark, sf_dir):
    return views.customers_by_district(frames.gold(spark, sf_dir))


@contract("view_best_customers", _BEST_CUSTOMERS)
def view_best_customers(spark, sf_dir):
    return views.best_customers(frames.gold(spark, sf_dir))


@contract("view_best_employees", _best_view("employee", "best_employee_rank", "sold"))
def view_best_employees(spark, sf_dir):
    return views.best_employees(frames.gold(spark, sf_dir))


@contract("distinct_by_bitmap", _CUSTOMER_DISTRICT_VIEW)
def distinct_by_bitmap(spark, sf_dir):
    """Distinct people per month from stored bitmaps of days, after two loads."""
    return maintained.maintained_view(frames.maintained_lake(spark, sf_dir), "vw_gld_customers_districts")


@contract("maintained_sales_districts", _DISTRICT_VIEW)
def maintained_sales_districts(spark, sf_dir):
    return maintained.maintained_view(frames.maintained_lake(spark, sf_dir), "vw_gld_sales_districts")


@contract("maintained_sales_employees", _EMPLOYEE_VIEW)
def maintained_sales_employees(spark, sf_dir):
    return maintained.maintained_view(frames.maintained_lake(spark, sf_dir), "vw_gld_sales_employees")


@contract("maintained_best_customers", _BEST_CUSTOMERS)
def maintained_best_customers(spark, sf_dir):
    return maintained.maintained_view(frames.maintained_lake(spark, sf_dir), "vw_gld_best_customers")


@contract("maintained_best_employees", _best_view("employee", "best_employee_rank", "sold"))
def maintained_best_employees(spark, sf_dir):
    return maintained.maintained_view(frames.maintained_lake(spark, sf_dir), "vw_gld_best_employees")


@contract(
    "ranked_order",
    """select o_orderkey, o_custkey, o_totalprice,
              row_number() over (order by o_totalprice desc, o_orderkey) as place from orders""",
)
def ranked_order(spark, sf_dir):
    """All orders by price, each with its place."""
    orders = frames.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return with_places(orders, F.desc("o_totalprice"), "o_orderkey")


@contract(
    "top_customers_per_month",
    f"""select * from ({_BEST_CUSTOMERS}) where best_customer_rank <= 3
        order by event_year, event_month, best_customer_rank, customer""",
)
def top_customers_per_month(spark, sf_dir):
    ranked = views.best_customers(frames.gold(spark, sf_dir))
    return ranked.filter("best_customer_rank <= 3").orderBy(
        "event_year", "event_month", "best_customer_rank", "customer"
    )


@contract(
    "largest_sales",
    f"""with {_GOLD} select order_id, employee, quantity_products from gold
        order by quantity_products desc, order_id, employee limit 50""",
)
def largest_sales(spark, sf_dir):
    """A top list, where the limit is the feature."""
    columns = ["order_id", "employee", "quantity_products"]
    gold = frames.gold(spark, sf_dir).select(*columns)
    return gold.orderBy(F.desc("quantity_products"), "order_id", "employee").limit(50)


@contract(
    "first_row",
    f"""with {_GOLD} select event_date, order_id, employee, quantity_products from gold
        order by event_date, order_id, employee, quantity_products limit 1""",
)
def first_row(spark, sf_dir):
    columns = ["event_date", "order_id", "employee", "quantity_products"]
    return frames.gold(spark, sf_dir).select(*columns).orderBy(*columns).limit(1)


@contract(
    "temp_view_query",
    f"""with {_GOLD} select district, count(order_id) as n_sales,
          cast(sum(quantity_products) as bigint) as quantity from gold group by district""",
)
def temp_view_query(spark, sf_dir):
    frames.gold(spark, sf_dir).createOrReplaceTempView("gold_sales")
    return spark.sql(
        "SELECT district, COUNT(order_id) AS n_sales, SUM(quantity_products) AS quantity "
        "FROM gold_sales GROUP BY district"
    )


def _gold_lake(spark, sf_dir):
    lake = frames.new_lake(spark)
    lake.append("gld_sales", frames.gold(spark, sf_dir))
    return lake


@contract("partitioned_table_roundtrip", f"with {_GOLD} select * from gold")
def partitioned_table_roundtrip(spark, sf_dir):
    return _gold_lake(spark, sf_dir).read("gld_sales")


@contract("catalog_view", _DISTRICT_VIEW)
def catalog_view(spark, sf_dir):
    lake = _gold_lake(spark, sf_dir)
    views.create_views(lake)
    return spark.table(lake.name("vw_gld_sales_districts"))


# -- hourly features ------------------------------------------------------------------

_EVENTS = f"sales as ({portable(frames.EVENTS_SQL)})"
_HOURLY = f"""
{_EVENTS}, hourly as (
  select district, event_date, event_hour,
         event_date + to_hours(event_hour) as event_datetime,
         avg(latitude) as avg_latitude, avg(longitude) as avg_longitude,
         cast(sum(quantity_products) as bigint) as sum_quantity_products
  from sales group by all),
means as (select district, avg(avg_latitude) as avg_latitude_district,
                 avg(avg_longitude) as avg_longitude_district from hourly group by all)"""


def _filled(days: str) -> str:
    return f"""{_HOURLY}, days as ({days}),
filled as (
  select d.district, d.event_date, h.event_hour,
         d.event_date + to_hours(h.event_hour) as event_datetime,
         coalesce(x.avg_latitude, m.avg_latitude_district) as avg_latitude,
         coalesce(x.avg_longitude, m.avg_longitude_district) as avg_longitude,
         coalesce(x.sum_quantity_products, 0) as sum_quantity_products
  from days d cross join (select range as event_hour from range(0, 24)) h
  left join hourly x on x.district = d.district and x.event_date = d.event_date
       and x.event_hour = h.event_hour
  join means m on m.district = d.district)"""


_ALL_DAYS = """select district, event_date from (select distinct district from hourly)
  cross join (select distinct event_date from hourly)"""
_OBSERVED_DAYS = "select distinct district, event_date from hourly"
_LAGS = ", ".join(
    f"lag(sum_quantity_products, {k}) over w as {series.lag_column(k)}" for k in range(1, 7)
)
_ROUND_POSITION = "round(avg_latitude, 6) as avg_latitude, round(avg_longitude, 6) as avg_longitude"
_FEATURES = f"""{_filled(_ALL_DAYS)}, lagged as (
  select *, {_LAGS}, cast(dayofweek(event_datetime) + 1 as int) as event_weekday
  from filled window w as (partition by district order by event_datetime)),
features as (select * from lagged where prev_quantity_products_6 is not null
             and event_datetime <= timestamp '{AS_OF}')"""


def _hourly(spark, sf_dir):
    return series.hourly_rollup(frames.event_sales(spark, sf_dir))


def _features(spark, sf_dir):
    return materialize(
        series.demand_features(frames.event_sales(spark, sf_dir), AS_OF), "features"
    )


@contract("hourly_rollup", f"with {_HOURLY} select * replace ({_ROUND_POSITION}) from hourly")
def hourly_rollup(spark, sf_dir):
    return naive(rounded(_hourly(spark, sf_dir), "avg_latitude", "avg_longitude"))


@contract(
    "mean_of_means",
    f"""with {_HOURLY} select district, round(avg_latitude_district, 6) as avg_latitude_district,
        round(avg_longitude_district, 6) as avg_longitude_district from means""",
)
def mean_of_means(spark, sf_dir):
    means = series.district_means(_hourly(spark, sf_dir))
    return rounded(means, "avg_latitude_district", "avg_longitude_district")


def _filled_frame(spark, sf_dir, days):
    hourly = materialize(_hourly(spark, sf_dir), "hourly")
    return naive(rounded(series.gap_fill(hourly, days), "avg_latitude", "avg_longitude"))


@contract("hourly_gap_fill",
          f"with {_filled(_ALL_DAYS)} select * replace ({_ROUND_POSITION}) from filled")
def hourly_gap_fill(spark, sf_dir):
    return _filled_frame(spark, sf_dir, series.ALL_DAYS)


@contract("hourly_gap_fill_observed",
          f"with {_filled(_OBSERVED_DAYS)} select * replace ({_ROUND_POSITION}) from filled")
def hourly_gap_fill_observed(spark, sf_dir):
    return _filled_frame(spark, sf_dir, series.OBSERVED_DAYS)


@contract("lag_features", f"with {_FEATURES} select * replace ({_ROUND_POSITION}) from features")
def lag_features(spark, sf_dir):
    features = series.demand_features(frames.event_sales(spark, sf_dir), AS_OF)
    return naive(rounded(features, "avg_latitude", "avg_longitude"))


@contract(
    "latest_row_per_group",
    f"""with {_HOURLY} select district, event_datetime, sum_quantity_products
        from hourly join (select district, max(event_datetime) as event_datetime
                          from hourly group by all) using (district, event_datetime)""",
)
def latest_row_per_group(spark, sf_dir):
    latest = latest_per_key(_hourly(spark, sf_dir), ["district"], "event_datetime")
    return naive(latest.select("district", "event_datetime", series.QUANTITY))


_NEXT = f"""{_FEATURES}, latest as (
  select * from features join (select district, max(event_datetime) as event_datetime
                               from features group by all) using (district, event_datetime))"""


@contract(
    "next_hour_rows",
    f"""with {_NEXT}, moved as (select *, event_datetime + interval 1 hour as moment from latest)
        select district, moment as event_datetime, cast(moment as date) as event_date,
               cast(hour(moment) as bigint) as event_hour, {_ROUND_POSITION},
               sum_quantity_products as prev_quantity_products,
               prev_quantity_products as prev_quantity_products_2,
               prev_quantity_products_2 as prev_quantity_products_3,
               prev_quantity_products_3 as prev_quantity_products_4,
               prev_quantity_products_4 as prev_quantity_products_5,
               prev_quantity_products_5 as prev_quantity_products_6,
               cast(dayofweek(moment) + 1 as int) as event_weekday
        from moved""",
)
def next_hour_rows(spark, sf_dir):
    rows = series.next_hour_rows(_features(spark, sf_dir))
    return naive(rounded(rows, "avg_latitude", "avg_longitude"))


_HALVES = f"""{_HOURLY},
stored as (select * from hourly where event_date <= date '2024-01-20'),
incoming as (select * replace (sum_quantity_products * 2 as sum_quantity_products)
             from hourly where event_date >= date '2024-01-15')"""


@contract(
    "feature_table_merge",
    f"""with {_HALVES} select district, event_date, event_hour, event_datetime, sum_quantity_products
        from incoming union all
        select district, event_date, event_hour, event_datetime, sum_quantity_products
        from stored anti join incoming using (district, event_datetime)""",
)
def feature_table_merge(spark, sf_dir):
    """Two overlapping slices merged into the partitioned feature table."""
    hourly = materialize(_hourly(spark, sf_dir), "hourly")
    absent = {series.lag_column(k): F.lit(0) for k in range(1, 7)}
    rows = hourly.withColumns(absent | {"event_weekday": F.dayofweek("event_datetime")})
    doubled = rows.withColumn(series.QUANTITY, F.col(series.QUANTITY) * 2)
    lake = frames.new_lake(spark)
    lake.merge("features_demand_forecast", rows.filter("event_date <= '2024-01-20'"))
    lake.merge("features_demand_forecast", doubled.filter("event_date >= '2024-01-15'"))
    stored = lake.read("features_demand_forecast")
    return naive(stored.select(*series.HOUR_KEYS, "event_datetime", series.QUANTITY))


# -- models and forecasts ----------------------------------------------------------------


@contract(
    "train_test_split",
    f"""with {_FEATURES} select 'train' as part, count(*) as n_rows,
          cast(sum(sum_quantity_products) as bigint) as quantity
        from features where event_date < date '{CUT_OFF}'
        union all select 'test', count(*), cast(sum(sum_quantity_products) as bigint) from features
        where event_date >= date '{CUT_OFF}' and event_date <= date '{LAST_DAY}'""",
)
def train_test_split(spark, sf_dir):
    parts = training.split_at(_features(spark, sf_dir), CUT_OFF, LAST_DAY)
    counted = [
        part.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(series.QUANTITY).alias("quantity"))
        .select(F.lit(name).alias("part"), "n_rows", "quantity")
        for name, part in zip(("train", "test"), parts)
    ]
    return counted[0].union(counted[1])


@contract(
    "index_encode_assemble",
    f"""with {_FEATURES}, ordered as (
          select district, row_number() over (order by count(*) desc, district) - 1 as place
          from features group by district)
        select f.district, event_datetime, cast(place as double) as district_index,
               cast(place + 1 as int) as hot_position,
               cast((select count(*) from ordered) + 11 as int) as vector_size,
               cast(event_weekday as double) as weekday_value,
               cast(prev_quantity_products_6 as double) as last_value
        from features f join ordered using (district)""",
)
def index_encode_assemble(spark, sf_dir):
    features = _features(spark, sf_dir)
    encoded = training.encoding_pipeline().fit(features).transform(features)
    vector = F.col("features6")
    width = vector_size(vector)
    return naive(
        encoded.select(
            "district", "event_datetime", "district_index",
            first_place_of(vector, 1.0).cast("int").alias("hot_position"),
            width.alias("vector_size"),
            vector_entry(vector, width - 10).alias("weekday_value"),
            vector_entry(vector, width - 1).alias("last_value"),
        )
    )


def _predictions(spark, sf_dir, regressor, handle_invalid="keep"):
    features = _features(spark, sf_dir)
    train, test = training.split_at(features, CUT_OFF, LAST_DAY)
    model = training.fit_model(train, regressor, handle_invalid)
    return naive(training.actual_and_predicted(model, train, test))


@contract("forecast_rf")
def forecast_rf(spark, sf_dir):
    return _predictions(spark, sf_dir, training.random_forest("features2", maxDepth=8, numTrees=10))


@contract("forecast_lr")
def forecast_lr(spark, sf_dir):
    return _predictions(spark, sf_dir, training.linear_regression("features6"))


@contract("forecast_lr_one_hot")
def forecast_lr_one_hot(spark, sf_dir):
    return _predictions(spark, sf_dir, training.linear_regression("features_one_hot"))


_TRAIN = f"{_FEATURES}, train as (select * from features where event_date < date '{CUT_OFF}')"


@contract(
    "forecast_rf_range",
    f"""with {_TRAIN} select district, event_datetime, true as within from train""",
)
def forecast_rf_range(spark, sf_dir):
    """Averages of training quantities never leave their range."""
    train, _ = training.split_at(_features(spark, sf_dir), CUT_OFF)
    model = training.fit_model(train, training.random_forest("features1", maxDepth=6, numTrees=5))
    range_ = train.agg(F.min(series.QUANTITY).alias("low"), F.max(series.QUANTITY).alias("high")).first()
    within = F.col("prediction").between(range_["low"], range_["high"])
    return naive(model.transform(train).select("district", "event_datetime", within.alias("within")))


@contract(
    "forecast_lr_means",
    f"""with {_TRAIN} select district, count(*) as n_rows,
          round(avg(sum_quantity_products), 6) as mean_actual, true as balanced
        from train group by district""",
)
def forecast_lr_means(spark, sf_dir):
    """Least squares with a column per district leaves no mean error in any district."""
    train, _ = training.split_at(_features(spark, sf_dir), CUT_OFF)
    exact = training.linear_regression("features6", tol=1e-10, maxIter=500)
    scored = training.fit_model(train, exact).transform(train)
    error = F.avg(F.col("prediction") - F.col(series.QUANTITY))
    return scored.groupBy("district").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(series.QUANTITY), 6).alias("mean_actual"),
        (F.abs(error) < 1e-3).alias("balanced"),
    )


_LAG_NAMES = [series.lag_column(k) for k in range(1, 7)]


@contract(
    "forecast_lr_one_hot_balance",
    f"""with {_TRAIN},
        groups as (
          select 'weekday' as kind, cast(event_weekday as varchar) as value, sum_quantity_products as q from train
          union all select 'hour', cast(event_hour as varchar), sum_quantity_products from train
          union all select 'district', district, sum_quantity_products from train)
        select kind, value, count(*) as n_rows, cast(sum(q) as bigint) as weight, true as balanced
        from groups group by kind, value
        union all {" union all ".join(
            f"select 'lag', '{c}', count(*), cast(sum({c}) as bigint), true from train" for c in _LAG_NAMES)}""",
)
def forecast_lr_one_hot_balance(spark, sf_dir):
    """Least squares leaves residuals that are orthogonal to every one-hot column and every lag."""
    train, _ = training.split_at(_features(spark, sf_dir), CUT_OFF)
    exact = training.linear_regression("features_one_hot", tol=1e-10, maxIter=500)
    scored = training.fit_model(train, exact).transform(train)
    scored = scored.withColumn("_error", F.col("prediction") - F.col(series.QUANTITY))
    one_hot = {"weekday": F.col("event_weekday"), "hour": F.col("event_hour"), "district": F.col("district")}
    terms = [(k, c.cast("string"), F.lit(1).cast("bigint"), F.col(series.QUANTITY)) for k, c in one_hot.items()]
    terms += [("lag", F.lit(c), F.col(c), F.col(c)) for c in _LAG_NAMES]
    term = F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), value.alias("value"), factor.alias("factor"), weight.alias("weight"))
        for kind, value, factor, weight in terms
    ]))
    # Relative to the size of the factor, so that a lag counts like an indicator.
    balance = F.abs(F.sum(F.col("_error") * F.col("factor"))) <= 1e-6 * F.sum(F.abs(F.col("factor"))) + 1e-6
    return scored.select("_error", term).groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("weight").alias("weight"), balance.alias("balanced")
    )


_SCORED = f"{_TRAIN}, scored as (select * from features where event_date <= date '{LAST_DAY}')"
_LINE = """line as (select regr_slope(sum_quantity_products, prev_quantity_products) as slope,
  regr_intercept(sum_quantity_products, prev_quantity_products) as base from train)"""


def _one_lag_model(train):
    return training.fit_model(
        train, training.linear_regression("last_hour"), more_sets={"last_hour": [series.lag_column(1)]}
    )


def _rounded_predictions(model, train, test):
    return naive(training.actual_and_predicted(model, train, test)).withColumn(
        "prediction", F.round("prediction", 4)
    )


@contract(
    "forecast_lr_one_lag",
    f"""with {_SCORED}, {_LINE} select district, event_datetime, sum_quantity_products,
          round(base + slope * prev_quantity_products, 4) as prediction from scored, line""",
)
def forecast_lr_one_lag(spark, sf_dir):
    """Least squares on the hour before, by value, for all training and test rows."""
    train, test = training.split_at(_features(spark, sf_dir), CUT_OFF, LAST_DAY)
    return _rounded_predictions(_one_lag_model(train), train, test)


@contract(
    "forecast_rf_mean",
    f"""with {_SCORED}, mean as (select avg(sum_quantity_products) as m from train)
        select district, event_datetime, sum_quantity_products, round(m, 4) as prediction
        from scored, mean""",
)
def forecast_rf_mean(spark, sf_dir):
    """A forest without splits predicts the mean of its training rows."""
    train, test = training.split_at(_features(spark, sf_dir), CUT_OFF, LAST_DAY)
    root = training.random_forest("features1", maxDepth=0, numTrees=1, bootstrap=False)
    return _rounded_predictions(training.fit_model(train, root), train, test)


@contract(
    "forecast_rf_one_split",
    f"""with {_SCORED},
        sides as (select cut, event_hour <= cut as low, count(*) as n,
                         cast(sum(sum_quantity_products) as double) as total
                  from train, (select range as cut from range(0, 23)) group by all),
        best as (select cut from sides group by cut having count(*) = 2
                 order by sum(total * total / n) desc, cut limit 1),
        leaves as (select event_hour <= cut as low, avg(sum_quantity_products) as m
                   from train, best group by all)
        select district, event_datetime, sum_quantity_products, round(m, 4) as prediction
        from scored, best join leaves on (event_hour <= cut) = low""",
)
def forecast_rf_one_split(spark, sf_dir):
    """One tree with one split: the hour that explains most variance, and the means beside it."""
    train, test = training.split_at(_features(spark, sf_dir), CUT_OFF, LAST_DAY)
    stump = training.random_forest("hour_only", maxDepth=1, numTrees=1, bootstrap=False)
    model = training.fit_model(train, stump, more_sets={"hour_only": ["event_hour"]})
    return _rounded_predictions(model, train, test)


@contract(
    "score_next_hour",
    f"""with {_NEXT}, train as (select * from features where event_date < date '{CUT_OFF}'), {_LINE}
        select district, event_datetime + interval 1 hour as event_datetime,
               round(base + slope * sum_quantity_products, 4) as sum_quantity_products
        from latest, line""",
)
def score_next_hour(spark, sf_dir):
    """The next hour of every district, scored by value."""
    features = _features(spark, sf_dir)
    model = _one_lag_model(training.split_at(features, CUT_OFF)[0])
    scored = forecast.score(model, series.next_hour_rows(features))
    return naive(scored.select(*forecast.FORECAST_COLUMNS)).withColumn(
        series.QUANTITY, F.round(series.QUANTITY, 4)
    )


def _search(spark, features):
    """The whole search space; fits that another query has stored are not repeated."""
    return training.grid_search(features, CUT_OFF, LAST_DAY, lake=frames.search_lake(spark))


@contract(
    "grid_search_report",
    f"""with {_TRAIN} select concat('features', cast(s as varchar)) as feature_set, cast(d * 10 as int) as max_depth,
          cast(t * 10 as int) as num_trees, 3::bigint as folds, (select count(*) from train) as n_validated,
          true as reported_is_least
        from range(1, 7) a(s), range(1, 4) b(d), range(1, 4) c(t)""",
)
def grid_search_report(spark, sf_dir):
    """Every candidate of the whole space with its folds; none is better than the reported one."""
    run = _search(spark, _features(spark, sf_dir))
    reported = [c[3] for c in run.candidate_rmse
                if (training.FEATURE_SETS[c[0]], c[1], c[2]) == (run.features, run.max_depth, run.num_trees)]
    fits = frames.search_lake(spark).read("search_fits").filter(F.col("search_id") == run.search)
    return fits.groupBy("feature_set", "max_depth", "num_trees").agg(
        F.countDistinct("fold").alias("folds"),
        F.sum("n_rows").alias("n_validated"),
        (F.avg("rmse") >= reported[0] - 1e-9).alias("reported_is_least"),
    )


@contract(
    "grid_search_quality",
    f"""with {_TRAIN} select count(*) as n_train, date '{CUT_OFF}' as cut_off_date, 54 as n_candidates,
          true as best_candidate, true as beats_the_mean from train""",
)
def grid_search_quality(spark, sf_dir):
    """The reported model has the lowest error of the searched ones and beats the mean."""
    features = _features(spark, sf_dir)
    run = _search(spark, features)
    best = min(run.candidate_rmse, key=lambda candidate: candidate[3])
    chosen = (training.FEATURE_SETS[best[0]], *best[1:3]) == (run.features, run.max_depth, run.num_trees)
    train, _ = training.split_at(features, CUT_OFF)
    spread = train.agg(
        F.count(F.lit(1)).alias("n_train"), F.stddev_pop(series.QUANTITY).alias("spread")
    )
    return spread.select(
        "n_train",
        F.lit(run.cut_off).cast("date").alias("cut_off_date"),
        F.lit(len(run.candidate_rmse)).alias("n_candidates"),
        F.lit(chosen).alias("best_candidate"),
        (F.lit(run.rmse_train) < F.col("spread")).alias("beats_the_mean"),
    )


@contract(
    "training_run_record",
    f"""with {_FEATURES} select date '{CUT_OFF}' as cut_off_date, count(*) as n_test,
          true as searched, true as same_rmse from features
        where event_date >= date '{CUT_OFF}' and event_date <= date '{LAST_DAY}'""",
)
def training_run_record(spark, sf_dir):
    """The recorded run read back, with its test error computed again from the model."""
    features = _features(spark, sf_dir)
    run = _search(spark, features)
    lake = frames.new_lake(spark)
    training.record_run(lake, run, "demand")
    _, test = training.split_at(features, CUT_OFF, LAST_DAY)
    error = F.col(series.QUANTITY) - F.col("prediction")
    again = run.model.transform(test).agg(
        F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(error * error)).alias("again")
    ).first()
    known_sets = F.array(*[F.array(*map(F.lit, columns)) for columns in training.FEATURE_SETS.values()])
    in_space = (
        F.col("max_depth").isin(training.GRID_DEPTHS)
        & F.col("num_trees").isin(training.GRID_TREES)
        & F.array_contains(known_sets, F.col("features"))
    )
    return lake.read("training_runs").select(
        "cut_off_date",
        F.lit(again["n_test"]).cast("bigint").alias("n_test"),
        in_space.alias("searched"),
        (F.abs(F.col("rmse_test") - F.lit(again["again"])) < 1e-9).alias("same_rmse"),
    )


@contract(
    "model_roundtrip",
    f"""with {_FEATURES} select district, count(*) as n_rows, true as same
        from features group by district""",
)
def model_roundtrip(spark, sf_dir):
    """A saved and reloaded model predicts what the original predicts."""
    features = _features(spark, sf_dir)
    model = training.fit_model(features, training.random_forest("features2", maxDepth=5, numTrees=5))
    root = shared_path(spark, "models")
    models.save_model(spark, model, root, "demand")
    reloaded = models.load_model(spark, root, "demand")
    both = model.transform(features).select("district", "features2", F.col("prediction").alias("p"))
    again = reloaded.stages[-1].transform(both)
    return again.groupBy("district").agg(
        F.count(F.lit(1)).alias("n_rows"), F.every(F.col("p") == F.col("prediction")).alias("same")
    )


@contract(
    "rmse_metric",
    f"""with {_FEATURES} select round(sqrt(avg(power(sum_quantity_products - prev_quantity_products, 2))), 6)
        as rmse from features""",
)
def rmse_metric(spark, sf_dir):
    """Error of predicting each hour by the hour before."""
    persisted = _features(spark, sf_dir).withColumn("prediction", F.col(series.lag_column(1)))
    return training.rmse(persisted).select(F.round("rmse", 6).alias("rmse"))


@contract(
    "publish_forecast",
    f"""with {_NEXT}, history as (select district, event_datetime, sum_quantity_products from features
                                  where event_date >= date '{TODAY}' - 10)
        select district, event_datetime, cast(sum_quantity_products as double) as sum_quantity_products
        from history union all
        select district, event_datetime + interval 1 hour, cast(sum_quantity_products as double)
        from latest""",
)
def publish_forecast(spark, sf_dir):
    """History and next hour published twice; the forecast repeats the last hour."""
    history = forecast.recent(_features(spark, sf_dir), TODAY)
    predicted = series.next_hour_rows(history).withColumn(
        series.QUANTITY, F.col(series.lag_column(1)).cast("double")
    )
    lake = frames.new_lake(spark)
    for _ in range(2):
        lake.merge("demand_forecast", forecast.with_history(history, predicted), only_changed=False)
    return naive(lake.read("demand_forecast").select(*forecast.FORECAST_COLUMNS))


@contract(
    "training_and_forecast",
    f"""with {_NEXT}, history as (select district, event_datetime, sum_quantity_products from features
                                  where event_date >= date '{TODAY}' - 10)
        select district, event_datetime, cast(sum_quantity_products as double) as actual, true as filled
        from history union all
        select district, event_datetime + interval 1 hour, null, true from latest""",
)
def training_and_forecast(spark, sf_dir):
    """Features, search, registered model and published forecast on stored tables.

    Forecast values depend on the trees; they are only checked to be present.
    """
    lake = frames.new_lake(spark)
    sales = frames.event_sales(spark, sf_dir)
    lake.merge("features_demand_forecast", series.demand_features(sales, AS_OF))
    run = _search(spark, lake.read("features_demand_forecast"))
    root = shared_path(spark, "models")
    training.record_run(lake, run, models.save_model(spark, run.model, root, "demand"))
    forecast.publish_forecast(lake, models.load_model(spark, root, "demand"), TODAY)
    quantity, hour = F.col(series.QUANTITY), F.col("event_datetime")
    return naive(
        lake.read("demand_forecast").select(
            "district", "event_datetime",
            F.when(hour <= F.lit(AS_OF).cast("timestamp"), quantity).alias("actual"),
            (quantity >= 0).alias("filled"),
        )
    )


def _maintained_features(spark, sales):
    """Gold sales arrive in two parts; the second refresh reads only the new days and the one before."""
    lake = frames.new_lake(spark)
    columns = lake.schema_of("gld_sales").fieldNames()
    gold = sales.withColumns({c: F.lit(None) for c in columns if c not in sales.columns})
    new_day = F.lit("2024-01-22").cast("date")
    lake.append("gld_sales", gold.filter(F.col("event_date") < new_day))
    maintained_features.refresh(lake)
    lake.append("gld_sales", gold.filter(F.col("event_date") >= new_day))
    maintained_features.refresh(lake, since="2024-01-22")
    features = maintained_features.maintained_features(lake, AS_OF)
    return naive(rounded(features, "avg_latitude", "avg_longitude"))


@contract(
    "incremental_features", f"with {_FEATURES} select * replace ({_ROUND_POSITION}) from features"
)
def incremental_features(spark, sf_dir):
    return _maintained_features(spark, frames.event_sales(spark, sf_dir))


_LATE = "(district <> (select min(district) from sales_all) or event_date >= date '2024-01-22')"


@contract(
    "late_district_features",
    f"""with {_FEATURES.replace(_EVENTS, f"sales_all as ({portable(frames.EVENTS_SQL)}), sales as (select * from sales_all where {_LATE})")}
        select * replace ({_ROUND_POSITION}) from features""",
)
def late_district_features(spark, sf_dir):
    """A district whose first sale comes with the second part gets rows on all earlier days."""
    sales = frames.event_sales(spark, sf_dir)
    first = sales.agg(F.min("district")).scalar()
    late = (F.col("district") != first) | (F.col("event_date") >= F.lit("2024-01-22").cast("date"))
    return _maintained_features(spark, sales.filter(late))


@contract(
    "refreshed_feature_table", f"with {_FEATURES} select * replace ({_ROUND_POSITION}) from features"
)
def refreshed_feature_table(spark, sf_dir):
    """The filled feature table, merged after each of two parts of the gold sales."""
    sales = frames.event_sales(spark, sf_dir)
    lake = frames.new_lake(spark)
    columns = lake.schema_of("gld_sales").fieldNames()
    gold = sales.withColumns({c: F.lit(None) for c in columns if c not in sales.columns})
    new_day = F.lit("2024-01-22").cast("date")
    lake.append("gld_sales", gold.filter(F.col("event_date") < new_day))
    forecast.refresh_features(lake, "2024-01-21 23:00:00")
    lake.append("gld_sales", gold.filter(F.col("event_date") >= new_day))
    forecast.refresh_features(lake, AS_OF, since="2024-01-22")
    stored = lake.read("features_demand_forecast")
    return naive(rounded(stored, "avg_latitude", "avg_longitude"))
