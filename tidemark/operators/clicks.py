"""Click-path reads re-aimed from the browser tracker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeparse import normalize_ts_text
from tidemark.operators.scans import ranged_max

EVENT_ORDER = ("event_ts", "topic", "partition_id", "offset_value")
# Fixed value: events kept per session in the recent-events view.
RECENT_EVENTS_LIMIT = 8


def normalized_times(events: DataFrame) -> DataFrame:
    """V2: each event time in the wire normal form (UTC, millis, ``Z``)."""
    return events.select("event_id", normalize_ts_text("event_ts").alias("ts"))


def page_dwell(bronze_clicks: DataFrame) -> DataFrame:
    """For each ``page_leave``, milliseconds since the latest
    ``page_enter`` of the same raw session at or before it (>= 0; NULL when
    there was none). The latest enter is a running maximum over ranges of enters
    and leaves; other events are dropped before any shuffle."""
    keyed = bronze_clicks.filter(F.col("session_id").isNotNull() & F.col("event_id").isNotNull()
                                 & F.col("event_type").isin("page_enter", "page_leave")).select(
        *EVENT_ORDER, "session_id", "event_id", "event_type", "page")
    enter_us = F.when(F.col("event_type") == "page_enter", F.unix_micros("event_ts"))
    order = [F.col(c).asc_nulls_first() for c in EVENT_ORDER]
    scanned = ranged_max(keyed, ["session_id"], order, enter_us, "_enter_us", "page_dwell")
    gap_us = F.unix_micros("event_ts") - F.col("_enter_us")
    return scanned.filter(F.col("event_type") == "page_leave").select(
        "event_id", "session_id", "page",
        F.when(F.col("_enter_us").isNotNull(),
               F.greatest(F.floor(gap_us / 1000), F.lit(0))).cast("bigint").alias("dwell_ms"),
    )


def recent_events(bronze_clicks: DataFrame, k: int = RECENT_EVENTS_LIMIT) -> DataFrame:
    """The latest ``k`` events per raw session, newest first. The
    ``row_number() <= k`` filter becomes a partial WindowGroupLimit."""
    w = Window.partitionBy("session_id").orderBy(*[F.col(c).desc_nulls_last() for c in EVENT_ORDER])
    return (
        bronze_clicks.filter(F.col("session_id").isNotNull() & F.col("event_id").isNotNull())
        .withColumn("rank", F.row_number().over(w).cast("bigint"))
        .filter(F.col("rank") <= k)
        .select("session_id", "event_id", "event_type", "page", "rank")
    )
