"""Structured Streaming ingest into bronze with dead-letter routing
(C1-C5, R1-R7, S21).

``start_bronze_ingest`` runs ``envelope stream -> foreachBatch`` where each
micro-batch is annotated and split into the valid bronze rows and the
dead-letter rows. Both writes are *idempotent per batch*: the
bronze tables are partitioned by ``(ingest_id, batch_id, [source_table,] dt)``
and a batch is written as ``INSERT OVERWRITE ... PARTITION (ingest_id = q,
batch_id = k, ...)`` in static mode, so a retried batch first drops whatever an earlier
attempt of the same batch left behind -- no duplicates, whichever write
failed. ``ingest_id`` is the streaming query's persistent id, which Spark
writes into a checkpoint when it is made: batch numbers restart at 0 for
every new checkpoint, and a checkpoint recreated at an old path is a new
writer, whose batches never replace those of its predecessor. Progress lives
in the checkpoint folder under the shared root.
"""

from __future__ import annotations

import datetime
import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas
from tidemark.operators import bronze as B
from tidemark.plans.catalog import Lakehouse, overwrite_mode
from tidemark.session import shared_path
from tidemark.sources import testdata

KINDS = {
    # kind: (annotate, split, valid table, dead-letter table)
    "cdc": (B.annotate_cdc, B.split_cdc, "bronze.pg_cdc_raw", "bronze.dlq_pg_cdc"),
    "clicks": (B.annotate_clicks, B.split_clicks, "bronze.clickstream_raw", "bronze.dlq_clickstream"),
}


def ingest_id_of(spark: SparkSession, checkpoint: str) -> str:
    """The persistent id of the query that owns a checkpoint (written before its first batch)."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


class CompactedBatch(RuntimeError):
    """A batch is written again after compaction has taken it in."""


def overwrite_batch(lakehouse: Lakehouse, logical: str, df: DataFrame, batch_id: int,
                    ingest_id: str) -> None:
    """Replace every row of ``(ingest_id, batch_id)`` in a bronze table with ``df``."""
    if not ingest_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"bad ingest id {ingest_id!r}")
    upto, _ = lakehouse.compacted(logical).get(ingest_id, (-1, 0))
    if 0 <= batch_id <= upto:
        raise CompactedBatch(f"batch {batch_id} of {ingest_id} is part of a compaction up to batch {upto}")
    spark = df.sparkSession
    spec = schemas.TABLES[logical]
    view = f"_tm_batch_{uuid.uuid4().hex}"
    dynamic = [c for c in spec.partition_by if c not in schemas.STATIC_BRONZE_PARTITIONS]
    data_cols = [f for f in spec.schema.fields if f.name not in spec.partition_by]
    part_types = {f.name: f.dataType for f in spec.schema.fields}
    # Tasks write their own rows, sorted by partition, without a shuffle of the raw text;
    # ``plans.compaction`` makes few files of closed batches.
    df.select(*[F.col(f.name).cast(f.dataType) for f in data_cols],
              *[F.col(c).cast(part_types[c]) for c in dynamic]
              ).createOrReplaceTempView(view)
    cols = ", ".join(f"`{c}`" for c in [f.name for f in data_cols] + dynamic)
    try:
        with overwrite_mode(spark, "full"):
            spark.sql(
                f"INSERT OVERWRITE TABLE {lakehouse.name(logical)} "
                f"PARTITION (ingest_id = '{ingest_id}', batch_id = {int(batch_id)}, "
                f"{', '.join(dynamic)}) SELECT {cols} FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


DlqSink = Callable[[DataFrame, int], None]


def batch_writer(lakehouse: Lakehouse, kind: str, ingest_id: str | Callable[[], str],
                 strict: bool = False, dlq_sink: DlqSink | None = None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function for one ingest kind (R3 / R4). A callable
    ``ingest_id`` is asked at every batch, as a query's id exists only once it runs.
    ``strict`` (clicks) also dead-letters events that break the contract.
    ``dlq_sink`` gets each batch's dead letters as envelope records (V4); if it
    fails, the batch fails and is tried again."""
    annotate, split, valid_table, dlq_table = KINDS[kind]
    if strict:
        if kind != "clicks":
            raise ValueError("the strict contract applies to click events")
        split = functools.partial(split, strict=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        # One ingest time per batch. Both writes read the source: each parses only the fields it
        # needs, which costs less than keeping the raw text of a batch on the executors' disks.
        now = F.lit(datetime.datetime.now(datetime.timezone.utc))
        valid, dlq = split(annotate(batch, now))
        writer_id = ingest_id() if callable(ingest_id) else ingest_id
        overwrite_batch(lakehouse, valid_table, valid, batch_id, writer_id)
        overwrite_batch(lakehouse, dlq_table, dlq, batch_id, writer_id)
        if dlq_sink:
            dlq_sink(B.dlq_records(dlq), batch_id)

    return write


def start_bronze_ingest(
    envelopes: DataFrame, kind: str, lakehouse: Lakehouse, checkpoint: str | None = None,
    available_now: bool = True, processing_time: str | None = None, query_name: str | None = None,
    strict: bool = False, dlq_sink: DlqSink | None = None,
) -> StreamingQuery:
    """Start the envelope stream into bronze. ``available_now`` drains what
    is there and stops (R1); otherwise it runs every ``processing_time``."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    lakehouse.init([KINDS[kind][2], KINDS[kind][3]])
    checkpoint = checkpoint or f"{lakehouse.root}/_checkpoints/bronze/{kind}"
    writer_id = functools.partial(ingest_id_of, lakehouse.spark, checkpoint)
    writer = (
        envelopes.writeStream.foreachBatch(
            batch_writer(lakehouse, kind, writer_id, strict=strict, dlq_sink=dlq_sink))
        .option("checkpointLocation", checkpoint)
    )
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def run_to_completion(query: StreamingQuery, timeout_seconds: float | None = None) -> bool:
    """Wait for an ``availableNow`` query (R7); stop it if it overruns.
    The session is never stopped here."""
    done = query.awaitTermination(timeout_seconds) if timeout_seconds else query.awaitTermination()
    if done is False:
        query.stop()
        return False
    return True


# -- test-table streams (the envelope contract over the driver's parquet) --

def _table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    schema = testdata.read_table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(sf_dir)


def click_envelope_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.clickstream_envelopes(_table_stream(spark, sf_dir, "events"))


def cdc_envelope_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table_stream(spark, sf_dir, "customer")
    orders = _table_stream(spark, sf_dir, "orders")
    static_customers = testdata.read_table(spark, sf_dir, "customer")
    return (
        testdata.user_envelopes(customers)
        .unionByName(testdata.account_envelopes(customers))
        .unionByName(testdata.transaction_envelopes(orders, static_customers))
    )


def fresh_lakehouse(spark: SparkSession, label: str) -> Lakehouse:
    """A private lakehouse (own root and namespace prefix) for one run."""
    tag = uuid.uuid4().hex[:10]
    return Lakehouse(spark, root=shared_path(spark, "runs", f"{label}-{tag}"), prefix=f"tm{tag}_")
