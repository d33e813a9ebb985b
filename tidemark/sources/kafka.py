"""Kafka sources (C1-C4) and the envelope contract shared with file sources.

Every source yields the *envelope*: ``topic, partition_id, offset_value,
key_json, value_json`` -- one row per broker record, key and value decoded to
text. The Kafka connector jar is optional; ``envelope_from_files`` offers the
same contract over a directory of envelope files (JSON lines or parquet).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The CDC topics are ``wallet.public.<table>`` for three tables,
# the clickstream topic is ``clickstream.events``.
CDC_TOPIC_PATTERN = r"wallet\.public\.(users|accounts|transactions)"
CLICKSTREAM_TOPIC = "clickstream.events"

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition_id", T.IntegerType()),
    T.StructField("offset_value", T.LongType()),
    T.StructField("key_json", T.StringType()),
    T.StructField("value_json", T.StringType()),
])


def decode_envelope(records: DataFrame, with_key: bool = True) -> DataFrame:
    """Kafka record columns -> envelope (C4): rename, bytes -> text."""
    cols = [
        F.col("topic"),
        F.col("partition").cast("int").alias("partition_id"),
        F.col("offset").cast("bigint").alias("offset_value"),
    ]
    if with_key:
        cols.append(F.col("key").cast("string").alias("key_json"))
    cols.append(F.col("value").cast("string").alias("value_json"))
    return records.select(*cols)


def read_kafka_stream(
    spark: SparkSession,
    bootstrap_servers: str,
    *,
    subscribe: str | None = None,
    subscribe_pattern: str | None = None,
    starting_offsets: str = "earliest",
    with_key: bool = True,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Streaming envelope from Kafka (C1 topic regex, C2 single topic, C3 start)."""
    if (subscribe is None) == (subscribe_pattern is None):
        raise ValueError("give exactly one of subscribe / subscribe_pattern")
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("startingOffsets", starting_offsets)
    )
    if subscribe is not None:
        reader = reader.option("subscribe", subscribe)
    else:
        reader = reader.option("subscribePattern", subscribe_pattern)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return decode_envelope(reader.load(), with_key=with_key)


def envelope_from_files(
    spark: SparkSession, path: str, fmt: str = "json", streaming: bool = True,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Envelope rows from files that already follow the envelope contract."""
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(ENVELOPE_SCHEMA).format(fmt)
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path).select(*[f.name for f in ENVELOPE_SCHEMA.fields])


def kafka_dlq_sink(bootstrap_servers: str, topic: str, options: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``dlq_sink`` of the ingest that sends the records to a dead-letter topic."""
    def send(records: DataFrame, batch_id: int) -> None:
        writer = records.write.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic)
        writer.options(**(options or {})).save()

    return send
