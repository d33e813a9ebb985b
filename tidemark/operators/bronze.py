"""Bronze annotation and valid / dead-letter split.

Given an envelope batch, ``annotate_cdc`` / ``annotate_clicks`` parse the
header fields once (``from_json`` with string leaves) and ``split_*`` return
the valid rows and the dead-letter rows. Only presence is checked here (S20):
a row is valid when it has a value and an ``op`` (CDC) / ``event_id`` (click).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.casts import to_integer, with_fields
from tidemark.functions.timeparse import epoch_millis_to_timestamp, parse_iso_timestamp, utc_date

# Dead-letter error codes.
ERR_NULL_VALUE = "null_value"
ERR_MISSING_OP = "missing_debezium_op"
ERR_MISSING_EVENT_ID = "missing_event_id"

CDC_HEADER = "op string, ts_ms string, source struct<table string>"
CLICK_FIELDS = (
    "event_id string, session_id string, user_id string, event_type string, page string, "
    "element_id string, x string, y string, dwell_ms string, ts string"
)


def _ingest_ts(ingest_ts: Column | None) -> Column:
    return ingest_ts if ingest_ts is not None else F.current_timestamp()


#: The column of a record's current row image, where it is parsed along with the header.
IMAGE = "after"


def annotate_cdc(envelope: DataFrame, ingest_ts: Column | None = None, image: Sequence[str] = ()) -> DataFrame:
    """Envelope -> envelope + op, source_table, event_ts (from ts_ms), ingest_ts.

    With ``image`` these fields of the row image (text) are parsed in the same pass and follow as a struct ``after``,
    for a reader that keeps no bronze table in between."""
    schema, names = CDC_HEADER, ["_op", "_ts_ms", "_source"]
    if image:
        schema += f", {IMAGE} struct<" + ", ".join(f"{f} string" for f in image) + ">"
        names.append("_image")
    parsed = with_fields(envelope, F.from_json("value_json", schema), names)
    return parsed.select(
        "topic", "partition_id", "offset_value", "key_json", "value_json",
        F.col("_op").alias("op"),
        F.col("_source.table").alias("source_table"),
        epoch_millis_to_timestamp(F.col("_ts_ms")).alias("event_ts"),
        _ingest_ts(ingest_ts).alias("ingest_ts"),
        *([F.col("_image").alias(IMAGE)] if image else []),
    )


Rule = tuple[Column, Column | str]


def _broken(rules: list[Rule]) -> Column:
    """The code of the first rule that holds; NULL for a valid row."""
    return F.coalesce(*[F.when(broken, F.lit(code) if isinstance(code, str) else code) for broken, code in rules])


def _split(annotated: DataFrame, table: str, dlq_table: str, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, dead-letter rows): the columns of both tables that the ingest does not add itself.

    A valid row stands on the day of its event, or of its ingest if it has no time; a dead letter on that of its ingest."""
    flagged = annotated.withColumn("error", _broken(rules))
    valid = flagged.filter(F.col("error").isNull()).withColumn("dt", utc_date(F.coalesce("event_ts", "ingest_ts")))
    dead = flagged.filter(F.col("error").isNotNull()).withColumns(
        {"dt": utc_date("ingest_ts"), "raw_value": F.col("value_json")})

    def columns(name: str) -> list[str]:
        return [c for c in schemas.TABLES[name].columns if c not in schemas.STATIC_BRONZE_PARTITIONS]

    image = [c for c in annotated.columns if c == IMAGE]
    return valid.select(*columns(table), *image), dead.select(*columns(dlq_table))


def split_cdc(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid bronze rows, dead-letter rows) of an annotated CDC batch."""
    return _split(annotated, "bronze.pg_cdc_raw", "bronze.dlq_pg_cdc", [
        (F.col("value_json").isNull(), ERR_NULL_VALUE), (F.col("op").isNull(), ERR_MISSING_OP)])


def annotate_clicks(envelope: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Envelope -> typed click columns (P2, P4, T2), parsed once per row."""
    names = [field.split()[0] for field in CLICK_FIELDS.split(", ")]
    parsed = with_fields(envelope, F.from_json("value_json", CLICK_FIELDS), [f"_{name}" for name in names])
    ev = lambda f: F.col(f"_{f}")
    return parsed.select(
        "topic", "partition_id", "offset_value", "value_json",
        ev("event_id").alias("event_id"),
        ev("session_id").alias("session_id"),
        ev("user_id").alias("user_id"),
        ev("event_type").alias("event_type"),
        ev("page").alias("page"),
        ev("element_id").alias("element_id"),
        to_integer(ev("x"), "int").alias("x"),
        to_integer(ev("y"), "int").alias("y"),
        to_integer(ev("dwell_ms"), "bigint").alias("dwell_ms"),
        parse_iso_timestamp(ev("ts")).alias("event_ts"),
        _ingest_ts(ingest_ts).alias("ingest_ts"),
    )


def split_clicks(annotated: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid bronze rows, dead-letter rows). ``strict`` also routes events
    that break the record contract (V1) to the dead letters, with the broken
    rules as the error (``contract:event_type,dwell_ms``)."""
    rules: list[Rule] = [(F.col("value_json").isNull(), ERR_NULL_VALUE), (F.col("event_id").isNull(), ERR_MISSING_EVENT_ID)]
    if strict:
        from tidemark.operators.quality import RAW_NUMBERS, event_reasons
        annotated = annotated.withColumn("_raw", F.from_json("value_json", RAW_NUMBERS)).withColumn("_reasons", event_reasons("_raw"))
        rules.append((F.col("_reasons") != "", F.concat(F.lit("contract:"), F.col("_reasons"))))
    return _split(annotated, "bronze.clickstream_raw", "bronze.dlq_clickstream", rules)


def dlq_envelope(dlq: DataFrame, source_topic_col: str = "topic") -> DataFrame:
    """Dead-letter rows -> ``{original, error, source_topic}`` JSON text (V4).

    ``original`` embeds the raw value as JSON when it parses (VARIANT keeps
    it as an object, not an escaped string); text that is not JSON is embedded
    as a JSON string, a null value as JSON null.
    """
    return dlq.select(
        "*",
        F.to_json(F.struct(
            F.coalesce(F.try_parse_json("raw_value"), F.col("raw_value").cast("variant")).alias("original"),
            F.col("error").alias("error"),
            F.col(source_topic_col).alias("source_topic"),
        ), {"ignoreNullFields": "false"}).alias("envelope"),
    )


def dlq_records(dlq: DataFrame) -> DataFrame:
    """Dead-letter rows as broker records: the session as key, the envelope as value (V4)."""
    return dlq_envelope(dlq).select(F.get_json_object("raw_value", "$.session_id").alias("key"), F.col("envelope").alias("value"))
