"""Mapping of the given tables onto the lakehouse schemas.

Each mapping exists as Spark frames here and as portable SQL for the checks.
Coordinates are dyadic fractions and quantities integers, so sums and means do
not depend on the order of rows.
"""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.plans import maintained
from ledgerlake.sources.lake import Lake
from ledgerlake.sources.shared import shared_path

GOLD_SQL = """
select cast(l_orderkey as string) order_id, s_name employee, c_name customer,
       6 + (l_orderkey % 1024) / 1024e0 latitude, -76 + (l_partkey % 1024) / 1024e0 longitude,
       n_name district, cast(l_quantity as int) quantity_products,
       concat(lpad(cast(day(o_orderdate) as string), 2, '0'),
              lpad(cast(month(o_orderdate) as string), 2, '0'),
              cast(year(o_orderdate) as string)) partition_date,
       cast(l_orderkey % 24 as int) event_hour, cast(day(o_orderdate) as int) event_day,
       cast(month(o_orderdate) as int) event_month, cast(year(o_orderdate) as int) event_year,
       cast(o_orderdate as date) event_date
from {lineitem} join {orders} on l_orderkey = o_orderkey
     join {customer} on o_custkey = c_custkey
     join {nation} on c_nationkey = n_nationkey
     join {supplier} on l_suppkey = s_suppkey
"""

SECOND_LOAD = "1998-06-01"

# Some customers are unknown, some points lie outside every region.
SALES_SQL = """
select (event_id * 104729 % 5003) / 1024e0 + 1 / 2048e0 latitude,
       (event_id * 7919 % 5000) / 1024e0 + 1 / 2048e0 longitude,
       {time_text} date,
       cast(event_id * 7 % 1600 as int) customer_id, cast(event_id % 100 as int) employee_id,
       cast(floor(value) as int) % 100 + 1 quantity_products, cast(event_id as string) order_id
from {events}
"""
SPARK_TIME_TEXT = "date_format(ts, 'dd/MM/yyyy HH:mm:ss')"
DUCKDB_TIME_TEXT = "strftime(ts, '%d/%m/%Y %H:%M:%S')"

# Districts grow with the number of users; most of their hours have no event.
EVENTS_SQL = """
select concat('District ', cast(cast(floor(user_id / 5e0) as bigint) as string)) district,
       cast(ts as date) event_date, cast(hour(ts) as bigint) event_hour,
       user_id % 64 / 64e0 latitude, -(user_id % 32) / 32e0 longitude,
       cast(floor(value) as bigint) + 1 quantity_products
from {events}
"""

POINTS_SQL = """
select o_orderkey, (o_orderkey * 7919 % 5000) / 1024e0 + 1 / 2048e0 longitude,
       (o_orderkey * 104729 % 5003) / 1024e0 + 1 / 2048e0 latitude
from {orders}
"""

# Concave pentagons on a 5 x 5 grid, one per nation.
DISTRICTS_SQL = """
select n_nationkey id, n_name district, cast(n_nationkey % 5 as double) x0,
       cast(floor(n_nationkey / 5e0) as double) y0, 1e0 size
from {nation}
"""

# One pentagon per supplier on a 1000 wide grid, in four sizes; larger ones overlap.
PARCELS_SQL = """
select s_suppkey id, s_name district, (s_suppkey % 50) / 8e0 x0,
       floor((s_suppkey % 1000) / 50e0) / 4e0 y0, pow(2e0, s_nationkey % 4) / 8e0 size
from {supplier}
"""

# Corners of the pentagon as fractions of its size, first corner repeated.
CORNERS = [(0.0, 0.0), (1.0, 0.0), (0.75, 0.5), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables(spark, sf_dir, name)[name]


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("lineitem", "orders", "customer", "nation", "supplier")
    return spark.sql(GOLD_SQL, **tables(spark, sf_dir, *names))


def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = SALES_SQL.replace("{time_text}", SPARK_TIME_TEXT)
    return spark.sql(text, **tables(spark, sf_dir, "events"))


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENTS_SQL, **tables(spark, sf_dir, "events"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS_SQL, **tables(spark, sf_dir, "orders"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
        blank.alias("phone"), blank.alias("email"), F.col("c_mktsegment").alias("address"),
    )


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.lit(None).cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("employee_id"), F.col("s_name").alias("name"),
        blank.alias("phone"), blank.alias("email"), blank.alias("address"),
        F.col("s_acctbal").alias("comission"),
    )


def _ring() -> list:
    return [
        F.array(F.col("x0") + dx * F.col("size"), F.col("y0") + dy * F.col("size"))
        for dx, dy in CORNERS
    ]


def pentagons(spark: SparkSession, sf_dir: str, sql: str, base: str) -> DataFrame:
    """id, district and one ring per row, with the geometry as GeoJSON text."""
    shapes = spark.sql(sql, **tables(spark, sf_dir, base))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*_ring())).alias("coordinates"))
    return shapes.select("id", "district", F.to_json(shape).alias("geojson"))


def pentagon_wkb(shapes: DataFrame) -> DataFrame:
    """The same shapes with the geometry as WKB bytes."""

    def encode(batches):
        import struct

        for batch in batches:
            geometry = [
                struct.pack("<BIII", 1, 3, 1, len(ring))
                + b"".join(struct.pack("<2d", *corner) for corner in ring)
                for ring in batch["ring"]
            ]
            yield batch.drop(columns="ring").assign(geometry=geometry)

    ringed = shapes.select("id", "district", F.array(*_ring()).alias("ring"))
    return ringed.mapInPandas(encode, "id bigint, district string, geometry binary")


def wkb_shapes(spark: SparkSession, sf_dir: str, sql: str, base: str) -> DataFrame:
    return pentagon_wkb(spark.sql(sql, **tables(spark, sf_dir, base)))


def staged_neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The district pentagons in the shape of the staged boundary files."""
    return wkb_shapes(spark, sf_dir, DISTRICTS_SQL, "nation").selectExpr(
        "id AS OBJECTID", "cast(id as string) AS CODIGO", "district AS NOMBRE",
        "concat('Area ', id) AS IDENTIFICACION", "cast(null as string) AS LIMITEMUNICIPIOID",
        "cast(null as bigint) AS SUBTIPO_COMUNACORREGIMIENTO",
        "cast(null as int) AS LINK_DOCUMENTO", "cast(null as double) AS SHAPEAREA",
        "cast(null as double) AS SHAPELEN", "geometry",
    )


def new_lake(spark: SparkSession) -> Lake:
    """An empty lake of its own in the shared folder."""
    root = shared_path(spark, "lake")
    return Lake(spark, root, prefix=f"l{uuid.uuid4().hex[:12]}_").ensure()


@cache
def search_lake(spark: SparkSession) -> Lake:
    """One lake per application for the fits of searches, which queries on the same rows share."""
    return new_lake(spark)


@cache
def maintained_lake(spark: SparkSession, sf_dir: str) -> Lake:
    """Gold sales loaded in two parts; the second refresh reads only the days of the second part."""
    lake = new_lake(spark)
    sales, later = gold(spark, sf_dir), F.col("event_date") >= F.lit(SECOND_LOAD).cast("date")
    lake.append("gld_sales", sales.filter(~later))
    maintained.refresh(lake)
    lake.append("gld_sales", sales.filter(later))
    maintained.refresh(lake, since=SECOND_LOAD)
    return lake


def write_events(sales: DataFrame, directory: str, files: int) -> None:
    sales.repartition(files).write.mode("append").json(directory)


# -- SQL counterparts --------------------------------------------------------

_BASES = {name: name for name in ("lineitem", "orders", "customer", "nation", "supplier", "events")}


def portable(sql: str) -> str:
    return sql.replace("{time_text}", DUCKDB_TIME_TEXT).format(**_BASES)


def edges_sql(shapes: str) -> str:
    """One row per edge of the pentagons in the relation ``shapes``."""
    pairs = zip(CORNERS, CORNERS[1:])
    return " union all ".join(
        f"select id, district, x0 + {a[0]} * size ax, y0 + {a[1]} * size ay, "
        f"x0 + {b[0]} * size bx, y0 + {b[1]} * size b_y from {shapes}"
        for a, b in pairs
    )


def geojson_sql() -> str:
    """GeoJSON text of a pentagon with x0, y0 and size."""
    corners = " || ', ' || ".join(
        f"'[' || cast(x0 + {dx} * size as varchar) || ', ' || cast(y0 + {dy} * size as varchar) || ']'"
        for dx, dy in CORNERS
    )
    return f"""'{{"type": "Polygon", "coordinates": [[' || {corners} || ']]}}'"""


def containment_sql(points: str, key: str) -> str:
    """Ray casting of all points against the relation ``edges``."""
    return f"""
      select {key}, id, district from {points} cross join edges
      where (ay > latitude) <> (b_y > latitude)
        and longitude < (bx - ax) * (latitude - ay)
                        / (case when b_y = ay then 1e0 else b_y - ay end) + ax
      group by {key}, id, district having count(*) % 2 = 1"""
