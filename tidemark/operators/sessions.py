"""Clickstream bronze -> sessionized silver events and sessions.

A session is split when the idle gap between consecutive events of the same
raw session is strictly more than ``gap_seconds`` whole seconds (S4). The
event order is ``event_ts, topic, partition_id, offset_value`` (S6). Events
without a raw session id keep a NULL analytics id (S5) and skip the scan.
The scan is the bucketed one from ``scans`` so that a hot raw session is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparse import utc_date, whole_seconds
from tidemark.operators.scans import bucketed_session_numbers, window_session_numbers

# Fixed value: idle gap of the analytics session, 30 minutes.
SESSION_IDLE_GAP_SECONDS = 30 * 60
EVENT_ORDER = ("event_ts", "topic", "partition_id", "offset_value")
SILVER_EVENT_COLUMNS = (
    "event_id", "session_id", "analytics_session_id", "user_id", "event_type", "page",
    "element_id", "x", "y", "dwell_ms", "event_ts", "dt",
)

# Columns that sessions do not depend on.
PAYLOAD_COLUMNS = ("user_id", "event_type", "page", "element_id", "x", "y", "dwell_ms")


def session_ordinal(n: Column) -> Column:
    """Zero-padded ordinal: ``001`` .. ``999``, then the plain number."""
    text = n.cast("string")
    return F.when(n < 1000, F.lpad(text, 3, "0")).otherwise(text)


def click_events_base(bronze_clicks: DataFrame) -> DataFrame:
    """Events with an id; event time falls back to ingest time (S8). Payload columns that were left out stay out."""
    return bronze_clicks.filter(F.col("event_id").isNotNull()).select(
        "topic", "partition_id", "offset_value", "event_id", "session_id",
        *[c for c in PAYLOAD_COLUMNS if c in bronze_clicks.columns],
        F.coalesce("event_ts", "ingest_ts").alias("event_ts"),
        F.coalesce(utc_date("event_ts"), F.col("dt")).alias("dt"),
        # Plain copies of the stored times: predicates on them reach the scan.
        F.col("event_ts").alias("_raw_ts"), F.col("ingest_ts").alias("_raw_ingest"),
    )


def _no_time() -> Column:
    return F.col("_raw_ts").isNull() & F.col("_raw_ingest").isNull()


def sessionize(
    bronze_clicks: DataFrame,
    gap_seconds: int = SESSION_IDLE_GAP_SECONDS,
    bucket_seconds: int = 900,
    method: str = "bucketed",
) -> DataFrame:
    """silver.clickstream_events (M4): each event with its analytics session id.

    The scan key is ``coalesce(session_id, event_id)``: an event without a
    raw session is a group of its own (no NULL-key hot spot) and gets a NULL
    analytics id."""
    base = click_events_base(bronze_clicks).withColumn(
        "_key", F.coalesce(F.col("session_id"), F.col("event_id")))
    order = [F.col(c).asc() for c in EVENT_ORDER]
    if method == "bucketed":
        numbered = bucketed_session_numbers(
            base, "_key", order, whole_seconds("event_ts"), gap_seconds, "_n",
            bucket_seconds=bucket_seconds, null_rows=_no_time())
    elif method == "window":
        numbered = window_session_numbers(
            base, "_key", order, whole_seconds("event_ts"), gap_seconds, "_n")
    else:
        raise ValueError(f"unknown method {method!r}")
    analytics = F.when(F.col("session_id").isNotNull(), F.concat(
        F.col("session_id"), F.lit("-"), session_ordinal(F.col("_n"))))
    return numbered.withColumn("analytics_session_id", analytics).select(
        *[c for c in SILVER_EVENT_COLUMNS if c not in PAYLOAD_COLUMNS or c in bronze_clicks.columns])


def session_flags(bronze_clicks: DataFrame, gap_seconds: int = SESSION_IDLE_GAP_SECONDS) -> DataFrame:
    """T7 + W2: per event, 1 when it opens a new session, else 0.

    Only the first event of a time bucket (width = the gap) can open a
    session, and it does when the previous bucket's last event is more than
    the gap before it. Both facts come from one partial aggregate per
    ``(key, bucket)`` -- ``min``/``max`` seconds and the ``min`` of the order
    tuple -- and a small scan over buckets; the events just join it.
    Events without a raw session are their own key (always 1)."""
    from pyspark.sql import Window

    base = (
        click_events_base(bronze_clicks)
        .withColumn("_key", F.coalesce(F.col("session_id"), F.col("event_id")))
        .withColumn("_s", whole_seconds("event_ts"))
        .withColumn("_bucket", F.floor(F.col("_s") / F.lit(gap_seconds)).cast("bigint"))
        .withColumn("_order", F.struct(*[F.col(c) for c in EVENT_ORDER]))
    )
    bucket_w = Window.partitionBy("_key").orderBy("_bucket")
    prev_last = F.lag("_last").over(bucket_w)
    summary = (
        base.filter(F.col("_s").isNotNull())
        .groupBy("_key", "_bucket")
        .agg(F.min("_s").alias("_start"), F.max("_s").alias("_last"), F.min("_order").alias("_first"))
        .withColumn("_opens", prev_last.isNull() | (F.col("_start") - prev_last > gap_seconds))
        .select("_key", "_bucket", "_first", "_opens")
    )
    # Rows that repeat the first event are equal; one of them opens the session.
    nth = F.row_number().over(Window.partitionBy("_key", "_bucket", "_order").orderBy("_s"))
    flag = (F.when(F.col("_s").isNull(), F.lit(1))
            .when(F.col("_order").eqNullSafe(F.col("_first")) & F.col("_opens") & (nth == 1), F.lit(1))
            .otherwise(F.lit(0)))
    return base.join(summary, ["_key", "_bucket"], "left").select(
        "event_id", flag.alias("new_session_flag"))


def sessions(silver_events: DataFrame) -> DataFrame:
    """silver.sessions (M5): one row per analytics session.

    Two levels: the events are counted per (session, raw session, user) with
    fixed-width aggregates only, which hash; texts are compared on those few rows."""
    seen = (
        silver_events.filter(F.col("analytics_session_id").isNotNull())
        .groupBy("analytics_session_id", "session_id", "user_id")
        .agg(F.min("event_ts").alias("first"), F.max("event_ts").alias("last"), F.count(F.lit(1)).alias("n"),
             F.sum(F.coalesce("dwell_ms", F.lit(0))).alias("dwell"), F.min("dt").alias("day"))
    )
    return (
        seen.groupBy("analytics_session_id")
        .agg(
            F.max("session_id").alias("raw_session_id"),
            F.max("user_id").alias("user_id"),
            F.min("first").alias("started_at"),
            F.max("last").alias("ended_at"),
            F.sum("n").alias("events_count"),
            F.sum("dwell").cast("bigint").alias("total_dwell_ms"),
            F.min("day").alias("dt"),
        )
        .withColumnRenamed("analytics_session_id", "session_id")
    )


SESSION_COLUMNS = ("session_id", "raw_session_id", "user_id", "started_at", "ended_at",
                   "events_count", "total_dwell_ms", "dt")


def gold_sessions(silver_sessions: DataFrame) -> DataFrame:
    """gold.sessions (M13): the serving projection of silver.sessions."""
    return silver_sessions.select(*SESSION_COLUMNS)
