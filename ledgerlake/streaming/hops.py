"""The three append-only streaming hops: events to bronze, silver and gold.

Every hop is stateless: it drains what is available, records its progress in
its own checkpoint and stops; running it again handles only new files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.types import StructType

from ledgerlake.operators.joins import BROADCAST_BYTES, SALTS
from ledgerlake.plans.sales import region_index, to_gold, to_silver
from ledgerlake.schemas import TABLES
from ledgerlake.sources.lake import Lake

# Fixed value: input files per micro-batch.  Raise it with the cluster.
MAX_FILES = 10
# Tasks that share a partition directory in a micro-batch.  Raise it with the batches.
WRITERS = 1


def limited(
    reader: DataStreamReader, max_files: int = MAX_FILES, max_bytes: int | None = None
) -> DataStreamReader:
    """Input of a micro-batch: up to ``max_bytes`` where given, else a number of files."""
    if max_bytes is not None:
        return reader.option("maxBytesPerTrigger", max_bytes)
    return reader.option("maxFilesPerTrigger", max_files)


def stream_json(
    lake: Lake, directory: str, schema: StructType, max_files: int = MAX_FILES,
    max_bytes: int | None = None,
) -> DataFrame:
    """JSON event files as a stream; the schema is given, never inferred."""
    reader = lake.spark.readStream.format("json").schema(schema)
    return limited(reader, max_files, max_bytes).load(directory)


def stream_table(
    lake: Lake, table: str, max_files: int = MAX_FILES, max_bytes: int | None = None
) -> DataFrame:
    """A table written by another hop, as a stream."""
    return limited(lake.spark.readStream, max_files, max_bytes).table(lake.name(table))


def gather_for_partitions(df: DataFrame, columns: list[str], writers: int) -> DataFrame:
    """Bring rows of one partition directory to ``writers`` tasks.

    Without it each task writes a file into every directory it has rows for.
    A directory with very many rows is still shared by ``writers`` tasks.
    """
    share = F.pmod(F.xxhash64(*df.columns), F.lit(writers))
    return df.repartition(*columns, share)


def append_stream(
    stream: DataFrame, lake: Lake, table: str, checkpoint: str, writers: int = WRITERS
) -> StreamingQuery:
    """Append everything available to ``table`` exactly once, then stop."""
    spec = TABLES[table]
    # Catalog tables keep partition columns last.
    rows = stream.select(*lake.schema_of(table).fieldNames())
    rows = gather_for_partitions(rows, spec.partition_by, writers)
    query = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .partitionBy(*spec.partition_by)
        .trigger(availableNow=True)
        .toTable(lake.name(table))
    )
    query.awaitTermination()
    lake.spark.catalog.refreshTable(lake.name(table))
    return query


def ingest_sales(
    lake: Lake,
    directory: str,
    checkpoint: str,
    max_files: int = MAX_FILES,
    writers: int = WRITERS,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Event files to bronze."""
    events = stream_json(lake, directory, lake.schema_of("brz_sales"), max_files, max_bytes)
    return append_stream(events, lake, "brz_sales", checkpoint, writers)


def refine_sales(
    lake: Lake,
    checkpoint: str,
    max_files: int = MAX_FILES,
    writers: int = WRITERS,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Bronze to silver: dates and location.  Regions are fixed when the run starts."""
    silver = to_silver(
        stream_table(lake, "brz_sales", max_files, max_bytes),
        region_index(lake.read("slv_neighborhoods")),
        broadcast_bytes=broadcast_bytes,
        salts=salts,
    )
    return append_stream(silver, lake, "slv_sales", checkpoint, writers)


def publish_sales(
    lake: Lake,
    checkpoint: str,
    max_files: int = MAX_FILES,
    writers: int = WRITERS,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    max_bytes: int | None = None,
) -> StreamingQuery:
    """Silver to gold: names.  Customers and employees are fixed when the run starts."""
    gold = to_gold(
        stream_table(lake, "slv_sales", max_files, max_bytes),
        lake.read("slv_customers"),
        lake.read("slv_employees"),
        broadcast_bytes=broadcast_bytes,
        salts=salts,
    )
    return append_stream(gold, lake, "gld_sales", checkpoint, writers)
