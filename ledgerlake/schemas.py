"""Tables of the lakehouse: layer, columns, partitioning and merge keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructType

BRONZE, SILVER, GOLD = "bronze", "silver", "gold"


@dataclass(frozen=True)
class TableSpec:
    layer: str
    name: str
    ddl: str
    keys: list[str] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=list)
    # Computed tables: a NULL key stands for one row, which a merge replaces.
    null_safe: bool = False

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


_CUSTOMER = "customer_id BIGINT, name STRING, phone STRING, email STRING, address STRING"
_EMPLOYEE = (
    "employee_id BIGINT, name STRING, phone STRING, email STRING, address STRING, "
    "comission DOUBLE"
)

# Column names and types of the stored tables.
_SPECS = [
    TableSpec(BRONZE, "brz_customers", _CUSTOMER, ["customer_id"]),
    TableSpec(BRONZE, "brz_employees", _EMPLOYEE, ["employee_id"]),
    TableSpec(
        BRONZE,
        "brz_municipalities",
        "DPTOMPIO STRING, DPTO_CCDGO STRING, MPIO_CCDGO STRING, MPIO_CNMBR STRING, "
        "MPIO_CCNCT STRING, geometry BINARY",
        ["DPTOMPIO"],
    ),
    TableSpec(
        BRONZE,
        "brz_neighborhoods",
        "OBJECTID BIGINT, CODIGO STRING, NOMBRE STRING, IDENTIFICACION STRING, "
        "LIMITEMUNICIPIOID STRING, SUBTIPO_COMUNACORREGIMIENTO BIGINT, LINK_DOCUMENTO INT, "
        "SHAPEAREA DOUBLE, SHAPELEN DOUBLE, geometry BINARY",
        ["OBJECTID"],
    ),
    TableSpec(
        BRONZE,
        "brz_sales",
        "latitude DOUBLE, longitude DOUBLE, date STRING, customer_id INT, employee_id INT, "
        "quantity_products INT, order_id STRING",
        partition_by=["employee_id"],
    ),
    TableSpec(SILVER, "slv_customers", _CUSTOMER, ["customer_id"]),
    TableSpec(SILVER, "slv_employees", _EMPLOYEE, ["employee_id"]),
    TableSpec(
        SILVER,
        "slv_municipalities",
        "code STRING, department_code STRING, municipality_code STRING, municipality STRING, "
        "ccnct_code STRING, geojson STRING",
        ["code"],
    ),
    TableSpec(
        SILVER,
        "slv_neighborhoods",
        "object_id BIGINT, code STRING, name STRING, identification STRING, "
        "limit_municipality_id STRING, subtype_community_district BIGINT, link_document INT, "
        "shape_area DOUBLE, shape_len DOUBLE, geojson STRING",
        ["object_id"],
    ),
    TableSpec(
        SILVER,
        "slv_sales",
        "order_id STRING, customer_id INT, employee_id INT, latitude DOUBLE, longitude DOUBLE, "
        "quantity_products INT, district STRING, neighborhood STRING, event_date TIMESTAMP, "
        "partition_date STRING, event_day INT, event_hour INT, event_minute INT, "
        "event_month INT, event_second INT, event_year INT",
        partition_by=["partition_date"],
    ),
    TableSpec(
        GOLD,
        "gld_sales",
        "order_id STRING, employee STRING, customer STRING, latitude DOUBLE, longitude DOUBLE, "
        "district STRING, quantity_products INT, partition_date STRING, event_hour INT, "
        "event_day INT, event_month INT, event_year INT, event_date DATE",
        partition_by=["event_date"],
    ),
    TableSpec(
        GOLD,
        "demand_forecast",
        "district STRING, event_datetime TIMESTAMP, sum_quantity_products DOUBLE, event_date DATE",
        ["district", "event_datetime"],
        ["event_date"],
    ),
    TableSpec(
        GOLD,
        "features_demand_forecast",
        "district STRING, event_date DATE, event_hour BIGINT, event_datetime TIMESTAMP, "
        "avg_latitude DOUBLE, avg_longitude DOUBLE, sum_quantity_products BIGINT, "
        "prev_quantity_products BIGINT, prev_quantity_products_2 BIGINT, "
        "prev_quantity_products_3 BIGINT, prev_quantity_products_4 BIGINT, "
        "prev_quantity_products_5 BIGINT, prev_quantity_products_6 BIGINT, event_weekday INT",
        ["district", "event_datetime"],
        ["event_date"],
        null_safe=True,
    ),
    # Own table: gold sales rolled up by hour, so that features need not rescan them.
    TableSpec(
        GOLD,
        "hourly_sales",
        "district STRING, event_date DATE, event_hour BIGINT, event_datetime TIMESTAMP, "
        "avg_latitude DOUBLE, avg_longitude DOUBLE, sum_quantity_products BIGINT",
        ["district", "event_datetime"],
        ["event_date"],
        null_safe=True,
    ),
    TableSpec(
        GOLD,
        "training_runs",
        "run_id STRING, model_path STRING, cut_off_date DATE, rmse_train DOUBLE, "
        "rmse_test DOUBLE, max_depth INT, num_trees INT, features ARRAY<STRING>",
    ),
    # Own table: the fits of searches, so that an ended search can go on.
    TableSpec(
        GOLD,
        "search_fits",
        "search_id STRING, feature_set STRING, max_depth INT, num_trees INT, fold INT, "
        "rmse DOUBLE, n_rows BIGINT",
    ),
]

# Own tables of the hops that act per micro-batch: a partition per batch of a stream.
BATCH_COLUMNS = ["stream", "batch_id"]


def _per_batch(layer: str, name: str, ddl: str, *inner: str) -> TableSpec:
    return TableSpec(layer, name, f"{ddl}, stream STRING, batch_id BIGINT", partition_by=[*BATCH_COLUMNS, *inner])


def _of(name: str, *without: str) -> str:
    """The columns of another table (of plain types)."""
    (spec,) = [s for s in _SPECS if s.name == name]
    return ", ".join(c for c in spec.ddl.split(", ") if c.split()[0] not in without)


_OWN = [
    _per_batch(BRONZE, "brz_sales_batches", _of("brz_sales")),
    _per_batch(SILVER, "slv_sales_batches", _of("slv_sales")),
    _per_batch(SILVER, "slv_rejects", _of("slv_sales", "district", "neighborhood")),
    _per_batch(GOLD, "gld_sales_batches", _of("gld_sales"), "event_date"),
    _per_batch(GOLD, "batch_log", "files BIGINT, n_rows BIGINT"),
    # Inserted and updated rows of the dimensions, in the order of their merges.
    *[
        TableSpec(BRONZE, f"{name}_feed", f"{_of(name)}, change STRING, version BIGINT", partition_by=["version"])
        for name in ("brz_customers", "brz_employees", "brz_municipalities", "brz_neighborhoods")
    ],
    TableSpec(SILVER, "feed_marks", "consumer STRING, source STRING, version BIGINT", ["consumer", "source"]),
    # Partial results of the analytic views.
    TableSpec(
        GOLD,
        "day_totals",
        "measure STRING, entity STRING, event_date DATE, event_year INT, event_month INT, "
        "sales BIGINT, products BIGINT, month DATE",
        ["measure", "entity", "event_date", "event_year", "event_month"],
        ["month"],
        null_safe=True,
    ),
    TableSpec(
        GOLD,
        "month_totals",
        "measure STRING, entity STRING, event_year INT, event_month INT, sales BIGINT, products BIGINT",
        ["measure", "entity", "event_year", "event_month"],
        ["event_year"],
        null_safe=True,
    ),
    TableSpec(
        GOLD,
        "day_people",
        "kind STRING, district STRING, event_date DATE, event_year INT, event_month INT, "
        "bucket BIGINT, bits BINARY, month DATE",
        ["kind", "district", "event_date", "event_year", "event_month", "bucket"],
        ["month"],
        null_safe=True,
    ),
    # Features by hour before absent positions are filled, and what fills them.
    TableSpec(
        GOLD,
        "district_days",
        "district STRING, event_date DATE, sum_latitude DOUBLE, n_latitude BIGINT, "
        "sum_longitude DOUBLE, n_longitude BIGINT, month DATE",
        ["district", "event_date"],
        ["month"],
        null_safe=True,
    ),
    TableSpec(
        GOLD, "hourly_features", _of("features_demand_forecast"), ["district", "event_datetime"], ["event_date"],
        null_safe=True,
    ),
    TableSpec(GOLD, "people_ids", "kind STRING, name STRING, id BIGINT"),
]

TABLES = {spec.name: spec for spec in [*_SPECS, *_OWN]}
