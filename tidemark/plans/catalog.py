"""Catalog and table I/O (C6-C13): namespaces, the 17 tables, overwrite
modes, refresh, statistics, scans by name, and table checks (Q1, Q2).

Tables are external parquet tables under one shared root (read from the
session, see ``tidemark.session``). ``prefix`` isolates several lakehouses
in one session (tests, parallel runs): namespace ``bronze`` becomes
``<prefix>bronze``.

Silver and gold tables are replaced whole by ``publish``: the rows go to a
fresh folder, and one change of the table's location in the catalog makes them
current. A write that fails leaves the old rows in place, and no reader meets
an empty or half-written table. The catalog does not list the partitions of
these tables; they follow from the folder, so that one change moves them all.

What must outlive a catalog that lasts as long as its session only is kept as
*marks* of a table, a small file under the root that is replaced at once: its
current folder, a commit under way (``plans.incremental``), and the
compacted batches of each ingest (``plans.compaction``). ``init`` in a new
catalog finds the current folder and the partitions of bronze again.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.session import delete_path, list_path, read_text, shared_path, write_text

#: Marks of a table: its folder, and for bronze tables by ingest what is compacted.
LOCATION, COMPACTED = "location", "compacted."
OVERWRITE_CONF = "spark.sql.sources.partitionOverwriteMode"


#: Whether the catalog lists the partitions of a table that is created; else they follow from its folder.
LISTED_CONF = "spark.sql.hive.manageFilesourcePartitions"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def overwrite_mode(spark: SparkSession, mode: str):
    """Context: the session's partition overwrite mode for ``dynamic`` or
    ``full`` table rebuilds."""
    return setting(spark, OVERWRITE_CONF, "dynamic" if mode == "dynamic" else "static")


def _ddl_type(dt) -> str:
    return dt.simpleString()


def _leaf(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


class Lakehouse:
    """The bronze / silver / gold tables of one root folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, prefix: str = "",
                 fmt: str = "parquet"):
        self.spark = spark
        self.root = (root or shared_path(spark, "lakehouse")).rstrip("/")
        self.prefix = prefix
        self.fmt = fmt

    # -- names ----------------------------------------------------------
    def name(self, logical: str) -> str:
        ns, table = logical.split(".")
        return f"{self.prefix}{ns}.{table}"

    def path(self, logical: str) -> str:
        ns, table = logical.split(".")
        return f"{self.root}/{ns}/{table}"

    # -- DDL (C7, C8) ---------------------------------------------------
    def init(self, tables: Iterable[str] | None = None) -> DataFrame:
        """Create the namespaces and tables that do not exist yet.

        Returns one row per table: name, partition columns, column count."""
        tables = list(tables or schemas.TABLES)
        for ns in {*schemas.NAMESPACES, *(t.split(".")[0] for t in tables)}:
            self.spark.sql(
                f"CREATE DATABASE IF NOT EXISTS {self.prefix}{ns} LOCATION '{self.root}/{ns}'")
        rows = []
        for logical in tables:
            spec = schemas.spec(logical)
            cols = ", ".join(f"`{f.name}` {_ddl_type(f.dataType)}" for f in spec.schema.fields)
            part = f" PARTITIONED BY ({', '.join(spec.partition_by)})" if spec.partition_by else ""
            options = ", ".join(f"'{k}' = '{v}'" for k, v in schemas.write_options(spec).items())
            options = f" OPTIONS ({options})" if options else ""
            new = not self.spark.catalog.tableExists(self.name(logical))
            where = (self.marks(logical).get(LOCATION) if new else None) or self.path(logical)
            with setting(self.spark, LISTED_CONF, "true" if spec.namespace == "bronze" else "false"):
                self.spark.sql(
                    f"CREATE TABLE IF NOT EXISTS {self.name(logical)} ({cols}) USING {self.fmt}"
                    f"{options}{part} LOCATION '{where}'")
            if new and spec.namespace == "bronze" and list_path(self.spark, where):
                self.recover_partitions(logical)
            rows.append((self.name(logical), ",".join(spec.partition_by), len(spec.columns)))
        return self.spark.createDataFrame(rows, "table string, partition_by string, columns int")

    # -- reads (C9, C11) ------------------------------------------------
    def table(self, logical: str) -> DataFrame:
        """Scan a table by name (C9). Metadata is refreshed first: bronze
        partitions are written by streaming queries in their own sessions."""
        name = self.name(logical)
        self.spark.catalog.refreshTable(name)
        rows = self.spark.table(name)
        return rows.filter(self.visible(logical)) if logical.startswith("bronze.") else rows

    # -- compacted batches ------------------------------------------------
    def _marks_path(self, logical: str) -> str:
        return f"{self.root}/_marks/{logical}.json"

    def marks(self, logical: str) -> dict[str, str]:
        return json.loads(read_text(self.spark, self._marks_path(logical)) or "{}")

    def mark(self, logical: str, name: str, value: str | None) -> None:
        """Set a mark of a table, or remove it. Jobs that mark one table follow each other."""
        marks = self.marks(logical) | {name: value}
        write_text(self.spark, self._marks_path(logical), json.dumps({k: v for k, v in marks.items() if v is not None}))

    def compacted(self, logical: str) -> dict[str, tuple[int, int]]:
        """By ingest: (upto, generation) of a bronze table's committed compaction."""
        found = {k.removeprefix(COMPACTED): v for k, v in self.marks(logical).items() if k.startswith(COMPACTED)}
        return {ingest: tuple(map(int, v.split(":"))) for ingest, v in found.items()}

    def visible(self, logical: str) -> Column:
        """Whether a bronze row counts, on its partition columns: a batch that compaction
        has not taken in, or the committed generation (batch ids below zero) of its ingest."""
        shown = F.col("batch_id") >= 0
        for ingest, (upto, generation) in self.compacted(logical).items():
            own = F.col("ingest_id") == ingest
            shown = (~own & shown) | (own & ((F.col("batch_id") > upto) | (F.col("batch_id") == -generation)))
        return shown

    def use(self, namespace: str) -> None:
        """Make a namespace current, so tables resolve by bare name (C11)."""
        self.spark.catalog.setCurrentDatabase(f"{self.prefix}{namespace}")

    def preview(self, logical: str, n: int = 10, order_by: Iterable[str] | None = None) -> DataFrame:
        """``LIMIT n`` preview (L2); ordered so that the answer is stable."""
        df = self.table(logical)
        keys = list(order_by or [c for c in df.columns])
        return df.orderBy(*[F.col(c).asc_nulls_first() for c in keys]).limit(n)

    # -- writes (C5, C6) ------------------------------------------------
    def overwrite(self, logical: str, df: DataFrame, mode: str = "dynamic",
                  set_mode: bool = True) -> None:
        """Rebuild a table from ``df`` (columns matched by name).

        ``dynamic``: replace only the partitions present in ``df`` (the
        reference behaviour, S13: a partition that emptied keeps stale rows).
        ``full``, and any table without partitions: replace the whole table, as ``publish`` does. With
        ``set_mode=False`` the caller has already set the session's overwrite
        mode (``overwrite_mode``) for a group of concurrent writes.
        """
        if mode not in ("dynamic", "full"):
            raise ValueError(f"unknown overwrite mode {mode!r}")
        if mode == "full" or not schemas.spec(logical).partition_by:
            self.publish(logical, df)
            return
        out = self._aligned(logical, df)
        if not set_mode:
            out.write.insertInto(self.name(logical), overwrite=True)
            return
        with overwrite_mode(self.spark, mode):
            out.write.insertInto(self.name(logical), overwrite=True)

    def location(self, logical: str) -> str:
        """The folder that holds a table's current rows."""
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(logical)}")
        return rows.filter(F.col("col_name") == "Location").first()["data_type"]

    def publish(self, logical: str, df: DataFrame) -> str:
        """Replace a silver or gold table by ``df`` at once; returns its new folder.

        The folder before it stays until the next publish, for readers that
        have planned on it; older ones are deleted. ``df`` may read the table."""
        spec = schemas.spec(logical)
        if spec.namespace == "bronze":
            raise ValueError("bronze tables are append-only")
        fresh = self.write_version(logical, df)
        self.switch(logical, fresh)
        return fresh

    def write_version(self, logical: str, df: DataFrame) -> str:
        """Write ``df`` to a fresh folder that nothing reads yet."""
        spec = schemas.spec(logical)
        fresh = f"{self.root}/_versions/{spec.namespace}/{spec.name}/{uuid.uuid4().hex}"
        try:
            writer = self._aligned(logical, df).write.format(self.fmt).options(**schemas.write_options(spec))
            (writer.partitionBy(*spec.partition_by) if spec.partition_by else writer).save(fresh)
        except BaseException:
            delete_path(self.spark, fresh)
            raise
        return fresh

    def switch(self, logical: str, fresh: str) -> None:
        """Make the rows of a folder current, and delete those before the last."""
        spec = schemas.spec(logical)
        old = self.location(logical)
        if _leaf(old) == _leaf(fresh):
            return
        self.mark(logical, LOCATION, fresh)
        self.spark.sql(f"ALTER TABLE {self.name(logical)} SET LOCATION '{fresh}'")
        self.spark.catalog.refreshTable(self.name(logical))
        versions = list_path(self.spark, f"{self.root}/_versions/{spec.namespace}/{spec.name}")
        for path in [*versions, self.path(logical)]:
            if _leaf(path) not in (_leaf(fresh), _leaf(old)):
                delete_path(self.spark, path)

    def append(self, logical: str, df: DataFrame) -> None:
        self._aligned(logical, df).write.insertInto(self.name(logical), overwrite=False)

    def _aligned(self, logical: str, df: DataFrame) -> DataFrame:
        """``insertInto`` is positional and the catalog lists partition
        columns last: select by name in the catalog's order, typed."""
        target = self.spark.table(self.name(logical)).schema
        out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])
        parts = schemas.spec(logical).partition_by
        # Few files per written partition; AQE sizes the write tasks.
        return out.hint("rebalance", *parts) if parts else out

    def recover_partitions(self, logical: str) -> None:
        """Register partitions written straight to the table folder."""
        if schemas.TABLES[logical].partition_by:
            self.spark.sql(f"ALTER TABLE {self.name(logical)} RECOVER PARTITIONS")
        self.spark.sql(f"REFRESH TABLE {self.name(logical)}")

    # -- maintenance (C12, C13) -----------------------------------------
    def refresh(self, tables: Iterable[str]) -> DataFrame:
        """Refresh metadata and compute column statistics, best effort:
        a failure is reported in the result, not raised."""
        rows = []
        for logical in tables:
            name = self.name(logical)
            try:
                self.spark.catalog.refreshTable(name)
                refreshed = "ok"
            except Exception as exc:  # noqa: BLE001 - reported, not fatal
                refreshed = f"failed: {type(exc).__name__}"
            try:
                self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
                analyzed = "ok"
            except Exception as exc:  # noqa: BLE001
                analyzed = f"failed: {type(exc).__name__}"
            rows.append((name, refreshed, analyzed))
        return self.spark.createDataFrame(rows, "table string, refresh string, analyze string")

    # -- checks (Q1, Q2) ------------------------------------------------
    def check_tables(self, tables: Iterable[str] | None = None) -> DataFrame:
        """Every table readable? One row per table: status and row count.

        Each table is counted by a job of its own, so that a table that
        cannot be read is reported and the others still are."""
        found = []
        for logical in tables or schemas.TABLES:
            name = self.name(logical)
            if not self.spark.catalog.tableExists(name):
                found.append((name, "missing", None))
                continue
            try:
                found.append((name, "ok", self.table(logical).count()))
            except Exception as exc:  # noqa: BLE001 - reported, not fatal
                found.append((name, f"failed: {type(exc).__name__}", None))
        return self.spark.createDataFrame(found, "table string, status string, rows bigint")

    def check_nonempty(self, tables: Iterable[str]) -> DataFrame:
        """Q2: which of ``tables`` are missing or empty."""
        return self.check_tables(tables).withColumn(
            "nonempty", F.coalesce(F.col("rows") > 0, F.lit(False)))


# Tables that must hold rows after a populated run (Q2).
REQUIRED_NONEMPTY = (
    "bronze.pg_cdc_raw", "bronze.clickstream_raw", "silver.transactions", "silver.accounts",
    "silver.users", "silver.clickstream_events", "gold.current_balances",
)
GOLD_TABLES = tuple(t for t in schemas.TABLES if t.startswith("gold."))
