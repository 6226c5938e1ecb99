"""Streaming hops that act per micro-batch: current dimensions, two outcomes, a batch log.

The hops of :mod:`ledgerlake.streaming.hops` fix their reference tables when a run starts and
have one sink.  The hops here hand every micro-batch to a function, which reads the reference
tables anew and may write several tables.  A micro-batch can be handed over twice (after a
failure between its writes and its commit); each table therefore keeps the rows of a batch in
a partition of its own, which a repetition replaces.  A batch is in the log once all its
rows are written.

``stream`` names the partitions; use one name per checkpoint, as batch ids count per checkpoint.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators.spatial import RegionIndex
from ledgerlake.plans.sales import enrich_dates, region_index, to_gold
from ledgerlake.schemas import BATCH_COLUMNS, TABLES
from ledgerlake.sources.lake import Lake
from ledgerlake.streaming.hops import MAX_FILES, stream_json, stream_table

_FILE = "_file"


def overwrite_batch(lake: Lake, table: str, stream: str, batch_id: int, rows: DataFrame) -> None:
    """Make ``rows`` the whole content of one batch's partition."""
    if not re.fullmatch(r"\w+", stream):
        raise ValueError(f"{stream!r} is no plain name")
    session = rows.sparkSession
    # Only the named partition is replaced, with all day folders below it.
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    fields = [f for f in lake.schema_of(table).fields if f.name not in BATCH_COLUMNS]
    inner = [c for c in TABLES[table].partition_by if c not in BATCH_COLUMNS]
    arranged = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    view = f"batch_{uuid.uuid4().hex}"
    (arranged.repartition(*inner) if inner else arranged).createOrReplaceTempView(view)
    partition = ", ".join([f"stream = '{stream}'", f"batch_id = {int(batch_id)}", *inner])
    try:
        session.sql(f"INSERT OVERWRITE TABLE {lake.name(table)} PARTITION ({partition}) SELECT * FROM {view}")
    finally:
        session.catalog.dropTempView(view)
    lake.spark.catalog.refreshTable(lake.name(table))


def log_batch(lake: Lake, stream: str, batch_id: int, rows: DataFrame, files: DataFrame | None = None) -> None:
    """Note a written batch: its rows, and its files where known."""
    counted = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    n_files = files.agg(F.countDistinct(_FILE)).first()[0] if files is not None else None
    overwrite_batch(
        lake, "batch_log", stream, batch_id, counted.withColumn("files", F.lit(n_files).cast("bigint"))
    )


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand everything available to ``handle``, batch by batch, then stop."""
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
    query.awaitTermination()
    return query


def ingest_batches(
    lake: Lake, directory: str, checkpoint: str, stream: str = "ingest", max_files: int = MAX_FILES
) -> StreamingQuery:
    """Event files to bronze, with a log of every batch's files and rows."""
    events = stream_json(lake, directory, lake.schema_of("brz_sales"), max_files)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            overwrite_batch(lake, "brz_sales_batches", stream, batch_id, batch)
            log_batch(lake, stream, batch_id, batch, files=batch.select(_FILE))
        finally:
            batch.unpersist()

    return run_batches(events.select("*", F.col("_metadata.file_path").alias(_FILE)), checkpoint, handle)


class CurrentRegions:
    """The region index of the neighborhoods' current snapshot, cut anew only when that changes."""

    def __init__(self, lake: Lake) -> None:
        self.lake = lake
        self.snapshot: str | None = None
        self.index: RegionIndex | None = None

    def get(self) -> RegionIndex:
        snapshot = self.lake.current_location("slv_neighborhoods")
        if self.index is None or snapshot != self.snapshot:
            self.lake.spark.catalog.refreshTable(self.lake.name("slv_neighborhoods"))
            self.index = region_index(self.lake.read("slv_neighborhoods"))
            self.snapshot = snapshot
        return self.index


def place_batch(lake: Lake, regions: RegionIndex, stream: str, batch_id: int, batch: DataFrame) -> None:
    """One batch of bronze sales to both outcomes: placed sales and those outside every region."""
    dated = enrich_dates(batch).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        overwrite_batch(lake, "slv_sales_batches", stream, batch_id, regions.assign(dated))
        overwrite_batch(lake, "slv_rejects", stream, batch_id, regions.unmatched(dated))
        log_batch(lake, stream, batch_id, dated)
    finally:
        dated.unpersist()


def place_batches(
    lake: Lake, checkpoint: str, stream: str = "placing", max_files: int = MAX_FILES
) -> StreamingQuery:
    """Bronze to silver and rejects; no sale is in neither, regions are those of the moment."""
    regions = CurrentRegions(lake)
    return run_batches(
        stream_table(lake, "brz_sales", max_files),
        checkpoint,
        lambda batch, batch_id: place_batch(lake, regions.get(), stream, batch_id, batch),
    )


def current_people(lake: Lake) -> tuple[DataFrame, DataFrame]:
    """Customers and employees as the catalog has them now."""
    for table in ("slv_customers", "slv_employees"):
        lake.spark.catalog.refreshTable(lake.name(table))
    return lake.read("slv_customers"), lake.read("slv_employees")


def publish_batches(
    lake: Lake,
    checkpoint: str,
    stream: str = "publishing",
    max_files: int = MAX_FILES,
    people: Callable[[Lake], tuple[DataFrame, DataFrame]] = current_people,
) -> StreamingQuery:
    """Silver to gold with the names that customers and employees have when a batch is handled."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        gold = to_gold(batch, *people(lake)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            overwrite_batch(lake, "gld_sales_batches", stream, batch_id, gold)
            log_batch(lake, stream, batch_id, gold)
        finally:
            gold.unpersist()

    return run_batches(stream_table(lake, "slv_sales", max_files), checkpoint, handle)
