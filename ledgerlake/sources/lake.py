"""The lakehouse tables as catalog tables: creation, reading, keyed merging."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.operators.joins import BROADCAST_BYTES, equal_keys, reference_join
from ledgerlake.operators.upsert import changes, require_unique_keys, upsert
from ledgerlake.schemas import BRONZE, GOLD, SILVER, TABLES, TableSpec
from ledgerlake.sources.shared import Scratch


class Lake:
    """Named tables below one storage root.

    ``prefix`` keeps several lakes apart in one catalog; ``root`` must be a path
    that all executors reach.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str = "") -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.prefix = prefix

    # -- names and schemas -------------------------------------------------

    def database(self, layer: str) -> str:
        return f"{self.prefix}{layer}"

    def name(self, table: str) -> str:
        """Fully qualified name of a table or view."""
        layer = TABLES[table].layer if table in TABLES else GOLD
        return f"{self.database(layer)}.{table}"

    def location(self, table: str) -> str:
        return f"{self.root}/{TABLES[table].layer}/{table}"

    def schema_of(self, table: str):
        """Schema of the stored table, for readers that must not infer one."""
        return self.spark.table(self.name(table)).schema

    def ensure(self) -> "Lake":
        """Create the databases and tables that do not exist yet."""
        for layer in (BRONZE, SILVER, GOLD):
            self.spark.sql(
                f"CREATE DATABASE IF NOT EXISTS {self.database(layer)} "
                f"LOCATION '{self.root}/{layer}'"
            )
        for spec in TABLES.values():
            self.spark.sql(self._create_statement(spec))
        return self

    def _create_statement(self, spec: TableSpec) -> str:
        partitioning = (
            f" PARTITIONED BY ({', '.join(spec.partition_by)})" if spec.partition_by else ""
        )
        return (
            f"CREATE TABLE IF NOT EXISTS {self.name(spec.name)} ({spec.ddl}) USING parquet"
            f"{partitioning} LOCATION '{self._first_location(spec)}'"
        )

    def _first_location(self, spec: TableSpec) -> str:
        # Merged tables without partitions keep one directory per snapshot.
        versioned = spec.keys and not spec.partition_by
        return self.location(spec.name) + ("/snapshot=0" if versioned else "")

    # -- reading and appending ----------------------------------------------

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def current_location(self, table: str) -> str:
        """The folder the catalog points to; a merged table without partitions gets a new one per merge."""
        described = self.spark.sql(f"DESCRIBE FORMATTED {self.name(table)}")
        return described.filter("col_name = 'Location'").first()["data_type"]

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to a batch table."""
        self._arranged(table, df).write.insertInto(self.name(table))

    def replace_partitions(self, table: str, rows: DataFrame) -> None:
        """Make ``rows`` the whole content of the partitions that occur in them; others are left alone.

        Needs no keys to be compared, as a merge does, where a refresh computes whole partitions.
        """
        if not TABLES[table].partition_by:
            raise ValueError(f"{table} has no partitions")
        with Scratch(self.spark) as scratch:
            self._rewrite(TABLES[table], self._stored_columns(table, rows), scratch)

    def _stored_columns(self, table: str, df: DataFrame) -> DataFrame:
        return df.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema_of(table)]
        )

    def _arranged(self, table: str, df: DataFrame) -> DataFrame:
        """Stored columns, with few files per partition directory.

        Rows of a partition meet in one task, and adaptive execution splits
        partitions that are too large for one.
        """
        rows = self._stored_columns(table, df)
        columns = TABLES[table].partition_by
        return rows.hint("rebalance", *columns) if columns else rows

    # -- keyed merging --------------------------------------------------------

    def merge(
        self,
        table: str,
        source: DataFrame,
        only_changed: bool = True,
        broadcast_bytes: int = BROADCAST_BYTES,
        feed: bool = False,
        computed: bool = False,
    ) -> int:
        """Upsert ``source`` by the table's keys; returns the number of written source rows.

        ``only_changed`` drops source rows equal to the stored ones first; when
        none is left, nothing is rewritten.  ``feed`` also appends the inserted and updated
        rows to the table's change feed, as its next version.  ``computed`` says that ``source`` is
        stored outside the table and grouped by the keys, so that it is neither written nor checked once more.
        """
        spec = TABLES[table]
        if not spec.keys:
            raise ValueError(f"{table} has no merge keys")
        with Scratch(self.spark) as scratch:
            return self._merge(spec, source, only_changed, broadcast_bytes, scratch, feed, computed)

    def _merge(
        self, spec: TableSpec, source: DataFrame, only_changed: bool, broadcast_bytes: int,
        scratch: Scratch, feed: bool, computed: bool,
    ) -> int:
        table = spec.name
        incoming = self._stored_columns(table, source)
        if not computed:
            # The source is read several times below and may be a long computation.
            incoming = scratch.materialize(incoming, f"merge-{table}")
            require_unique_keys(incoming, spec.keys, spec.null_safe)
        if self.read(table).isEmpty():
            if feed:
                self._feed(spec, incoming, broadcast_bytes)
            if spec.partition_by:
                # Nothing stored can be replaced or read again.
                self.append(table, incoming)
                self.spark.catalog.refreshTable(self.name(table))
            else:
                self._rewrite(spec, incoming, scratch)
            return incoming.count()
        if only_changed:
            stored = self._touched_partitions(spec, incoming)
            incoming = scratch.materialize(
                changes(
                    stored, incoming, spec.keys,
                    broadcast_bytes=broadcast_bytes, null_safe=spec.null_safe,
                ),
                f"changed-{table}",
            )
        written = incoming.count()
        if written and feed:
            self._feed(spec, incoming, broadcast_bytes)
        if written:
            stored = self._touched_partitions(spec, incoming)
            merged = upsert(
                stored, incoming, spec.keys, check_source=False,
                broadcast_bytes=broadcast_bytes, null_safe=spec.null_safe,
            )
            self._rewrite(spec, merged, scratch)
        return written

    def feed_version(self, table: str) -> int:
        """The latest version of a table's change feed, 0 before the first."""
        return self.read(f"{table}_feed").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _feed(self, spec: TableSpec, incoming: DataFrame, broadcast_bytes: int) -> None:
        """Append the rows a merge is about to write.

        They are written before the table: a merge that was ended in between is repeated as a
        further version with the same rows, which readers of the feed apply by key.
        """
        known = self._touched_partitions(spec, incoming).select(*spec.keys).withColumn("_known", F.lit(True))
        joined = reference_join(incoming, known, equal_keys(spec.keys, spec.null_safe), "left", broadcast_bytes)
        change = F.when(F.col("side._known"), "update").otherwise("insert")
        rows = joined.select("fact.*", change.alias("change"))
        version = self.feed_version(spec.name) + 1
        self.append(f"{spec.name}_feed", rows.withColumn("version", F.lit(version)))

    def changes_since(self, table: str, version: int) -> DataFrame:
        """The latest feed row of every key that changed after ``version``; earlier versions are not read."""
        spec = TABLES[table]
        rows = self.read(f"{table}_feed").filter(F.col("version") > version)
        names = [f.name for f in spec.schema.fields]
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in spec.keys])
        latest = (
            rows.filter(known).groupBy(*spec.keys)
            .agg(F.max_by(F.struct(*names), "version").alias("row")).select("row.*")
        )
        # Rows without a key are never replaced, so each of them counts.
        return latest.select(*names).unionByName(rows.filter(~known).select(*names))

    def _touched_partitions(self, spec: TableSpec, incoming: DataFrame) -> DataFrame:
        """The stored rows that ``incoming`` can meet.

        For a partitioned table these are the partitions that occur in
        ``incoming``, pruned at planning: the partition column of a merged table
        follows from its keys.
        """
        stored = self.read(spec.name)
        if not spec.partition_by:
            return stored
        (column,) = spec.partition_by
        # One value per partition directory to rewrite: calendar days.
        days = [row[0] for row in incoming.select(column).distinct().collect()]
        known = F.col(column).isin([day for day in days if day is not None])
        return stored.filter(known | F.col(column).isNull() if None in days else known)

    def _rewrite(self, spec: TableSpec, merged: DataFrame, scratch: Scratch) -> None:
        name = self.name(spec.name)
        if spec.partition_by:
            # The merged rows are complete in the shared folder before the first
            # stored partition is replaced; other partitions are left alone.
            settled = scratch.write(merged, f"merged-{spec.name}")
            # A session of its own: the setting decides between replacing these
            # partitions and replacing the table, and the caller's may differ.
            writing = self.spark.newSession()
            writing.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            rows = writing.read.schema(merged.schema).parquet(settled)
            self._arranged(spec.name, rows).write.insertInto(name, overwrite=True)
        else:
            # Readers keep the old snapshot until the catalog points to the new one.
            snapshot = f"{self.location(spec.name)}/snapshot={uuid.uuid4().hex}"
            merged.write.parquet(snapshot)
            self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{snapshot}'")
        self.spark.catalog.refreshTable(name)

    def drop_old_snapshots(self, table: str) -> int:
        """Delete snapshots of a merged table that the catalog no longer points to.

        Call it when no reader of an older snapshot is left.
        """
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.location(table))
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        current = self.current_location(table)
        stale = [
            status.getPath()
            for status in files.listStatus(folder)
            if status.getPath().getName() != current.rstrip("/").rsplit("/", 1)[-1]
        ]
        for path in stale:
            files.delete(path, True)
        return len(stale)
