"""Incremental silver (M1-M4) and the daily marts behind it.

A silver table remembers which bronze batches it has taken in. A run reads
only the partitions of the others:

* **Current rows (M1-M3).** The latest change of each key in the new batches is
  compared with the position that the key's row comes from; only keys whose
  change is newer are touched, wherever their old row is. Of a table with day
  partitions the days of the old and the new rows are rewritten, no others.
* **Sessionized events (M4).** A raw session is remembered as the spans of its
  sessions. The new events are short spans of their own; merging both gives the
  sessions' new numbers, as a span has no idle gap inside. Stored events
  are touched only where their session's number has changed, by a late event
  before it or between two sessions. The ingest gives every event a time; rows
  without any are not supported here.

Each run has one commit point. New rows and state are written to fresh folders;
then a note among the table's marks names them, and only then are they put in
place, in steps that can be repeated. A run that fails before the note
leaves everything as it was; after it, the next run first finishes the steps.
Runs of one table follow each other; they are not meant to overlap.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.timeparse import utc_date, whole_seconds
from tidemark.operators import cdc, sessions
from tidemark.plans.catalog import Lakehouse, overwrite_mode
from tidemark.plans.refresh import DAILY_BUILDS, builds
from tidemark.session import delete_path, list_path, shared_path, stored

BRONZE = {
    "silver.transactions": "bronze.pg_cdc_raw", "silver.users": "bronze.pg_cdc_raw",
    "silver.accounts": "bronze.pg_cdc_raw", "silver.clickstream_events": "bronze.clickstream_raw",
}
NOTE = "pending"
Days = set[_dt.date]


def _consumed(logical: str) -> str:
    return f"state.{logical.split('.')[1]}_consumed"


def bronze_batches(lh: Lakehouse, bronze: str) -> DataFrame:
    """(ingest_id, batch_id) of all partitions of a bronze table, from the catalog alone."""
    listed = lh.spark.sql(f"SHOW PARTITIONS {lh.name(bronze)}")
    found = [F.regexp_extract("partition", rf"{c}=([^/]+)", 1) for c in ("ingest_id", "batch_id")]
    batches = listed.select(found[0].alias("ingest_id"), found[1].cast("bigint").alias("batch_id")).distinct()
    return batches.filter(lh.visible(bronze))


def new_batches(lh: Lakehouse, logical: str) -> list[tuple[str, int]]:
    """The batches that a silver table has not taken in. Compaction keeps their number small."""
    seen = lh.table(_consumed(logical))
    rows = bronze_batches(lh, BRONZE[logical]).join(seen, ["ingest_id", "batch_id"], "left_anti")
    return sorted((r.ingest_id, r.batch_id) for r in rows.collect())


def in_batches(batches: list[tuple[str, int]]) -> Column:
    """Whether a bronze row is in one of the batches, on the partition columns alone."""
    by_ingest: dict[str, list[int]] = {}
    for ingest, batch in batches:
        by_ingest.setdefault(ingest, []).append(batch)
    found = F.lit(False)
    for ingest, own in by_ingest.items():
        found = found | ((F.col("ingest_id") == ingest) & F.col("batch_id").isin(own))
    return found


# -- the commit ---------------------------------------------------------

def _days(df: DataFrame, column: str = "dt") -> Days:
    """The distinct days of a column: a calendar's worth at most."""
    return {r[0] for r in df.select(column).distinct().collect() if r[0] is not None}


def commit(lh: Lakehouse, logical: str, rows: DataFrame, days: Days | None, state: dict[str, DataFrame]) -> None:
    """Put ``rows`` in place of the given ``days`` of a table (of all its rows if None), with the new ``state``."""
    note = {"days": None if days is None else sorted(map(str, days)), "state": {}}
    if days is None:
        note["rows"] = lh.write_version(logical, rows)
    else:
        note["rows"] = shared_path(lh.spark, "pending", logical, unique=True)
        lh._aligned(logical, rows).write.parquet(note["rows"])
    for name, df in state.items():
        note["state"][name] = lh.write_version(name, df)
    lh.mark(logical, NOTE, json.dumps(note))
    finish(lh, logical)


def finish(lh: Lakehouse, logical: str) -> bool:
    """Carry out what a table's note says, if it has one. Every step may be repeated."""
    found = lh.marks(logical).get(NOTE)
    if found is None:
        return False
    note = json.loads(found)
    if note["days"] is None:
        lh.switch(logical, note["rows"])
    else:
        rows = lh.spark.read.schema(lh.spark.table(lh.name(logical)).schema).parquet(note["rows"])
        replace_days(lh, logical, rows, {_dt.date.fromisoformat(d) for d in note["days"]})
    for name, path in note["state"].items():
        lh.switch(name, path)
    lh.mark(logical, NOTE, None)
    if note["days"] is not None:
        delete_path(lh.spark, note["rows"])
    return True


def replace_days(lh: Lakehouse, logical: str, rows: DataFrame, days: Days) -> None:
    """Replace the given day partitions by ``rows``; a day without rows goes."""
    with overwrite_mode(lh.spark, "dynamic"):
        lh.overwrite(logical, rows, mode="dynamic", set_mode=False)
    emptied = {f"dt={d}" for d in days - _days(rows)}
    for path in list_path(lh.spark, lh.location(logical)):
        if path.rstrip("/").rpartition("/")[2] in emptied:
            delete_path(lh.spark, path)
    lh.spark.catalog.refreshTable(lh.name(logical))


def _taken(lh: Lakehouse, logical: str, batches: list[tuple[str, int]]) -> DataFrame:
    new = lh.spark.createDataFrame(batches, schemas.CONSUMED)
    return lh.table(_consumed(logical)).unionByName(new)


# -- current rows (M1-M3) -----------------------------------------------

ORDER = ("event_ts", "partition_id", "offset_value")


def merge_current(lh: Lakehouse, table: str, apply_deletes: bool = False) -> Days:
    """Take the new batches into silver ``transactions``, ``users`` or ``accounts``; returns the days that changed."""
    logical, positions_table = f"silver.{table}", f"state.{table}_positions"
    lh.init([logical, BRONZE[logical], _consumed(logical), positions_table])
    finish(lh, logical)
    batches = new_batches(lh, logical)
    if not batches:
        return set()
    bronze = lh.table(BRONZE[logical]).filter(in_batches(batches))
    key = schemas.spec(logical).columns[0]
    daily = bool(schemas.spec(logical).partition_by)
    latest = cdc.latest_images(bronze, table, apply_deletes)
    position = F.struct(*[F.col(c).alias(c) for c in ORDER])
    fresh = latest.select(F.struct(*cdc.silver_columns(table)).alias("row"), position.alias("position"),
                          "key", (F.col("op") == cdc.DELETE_OP).alias("gone"))
    positions = lh.table(positions_table)
    old = positions.select("key", F.struct(*ORDER).alias("old"), "old_dt")
    winners = stored(fresh.join(old, "key", "left").filter(F.col("old").isNull() | (F.col("position") > F.col("old"))), "winners")
    live = winners.filter(~F.col("gone")).select("row.*")
    untouched = lh.table(logical).join(winners.select(F.col("key").alias(key)), key, "left_anti")
    days = None
    if daily:
        moved = winners.select(F.explode(F.array("old_dt", F.when(~F.col("gone"), F.col("row.dt")))).alias("dt"))
        days = _days(moved)
        untouched = untouched.filter(F.col("dt").isin(sorted(days)))
    row_dt = F.when(~F.col("gone"), F.col("row.dt")) if daily else F.lit(None).cast("date")
    kept = positions.join(winners.select("key"), "key", "left_anti")
    placed = kept.unionByName(winners.select("key", "position.*", row_dt.alias("old_dt")))
    commit(lh, logical, untouched.unionByName(live), days,
           {positions_table: placed, _consumed(logical): _taken(lh, logical, batches)})
    return days or set()


# -- sessionized events (M4) --------------------------------------------

def merged_spans(old: DataFrame, new: DataFrame, gap_seconds: int) -> DataFrame:
    """Number the spans (session_id, start, last, tag) of both tables: ``number`` is the session a span falls into.

    A span opens a session when it starts more than the gap after all
    earlier ones of its raw session have ended."""
    w = Window.partitionBy("session_id").orderBy("start", "last", "tag")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("last").over(before)
    opens = F.when(reach.isNull() | (F.col("start") - reach > gap_seconds), 1).otherwise(0)
    flagged = old.unionByName(new).withColumn("opens", opens)
    return flagged.withColumn("number", F.sum("opens").over(w).cast("bigint")).drop("opens")


def merge_events(lh: Lakehouse, gap_seconds: int = sessions.SESSION_IDLE_GAP_SECONDS) -> Days:
    """Take the new click batches into ``silver.clickstream_events``; returns the days that changed."""
    logical, spans_table = "silver.clickstream_events", "state.session_spans"
    lh.init([logical, BRONZE[logical], _consumed(logical), spans_table])
    finish(lh, logical)
    batches = new_batches(lh, logical)
    if not batches:
        return set()
    events = sessions.click_events_base(lh.table(BRONZE[logical]).filter(in_batches(batches)))
    events = stored(events.withColumn("_s", whole_seconds("event_ts")).withColumn(
        "tag", F.floor(F.col("_s") / F.lit(gap_seconds)).cast("bigint")), "new_events")
    named = events.filter(F.col("session_id").isNotNull())
    # Events of one bucket are never more than the gap apart: a bucket is a span.
    new = named.groupBy("session_id", "tag").agg(F.min("_s").alias("start"), F.max("_s").alias("last"))
    spans = lh.table(spans_table)
    touched = new.select("session_id").distinct()
    old = spans.join(touched, "session_id", "left_semi").withColumn("is_new", F.lit(False))
    numbered = stored(merged_spans(
        old.select("session_id", "start", "last", F.col("ordinal").alias("tag"), "is_new"),
        new.select("session_id", "start", "last", "tag", F.lit(True).alias("is_new")), gap_seconds), "spans")

    number = F.concat(F.col("session_id"), F.lit("-"), sessions.session_ordinal(F.col("number")))
    former = F.concat(F.col("session_id"), F.lit("-"), sessions.session_ordinal(F.col("tag")))
    changed = numbered.filter(~F.col("is_new") & (F.col("tag") != F.col("number")))
    renamed = changed.select(former.alias("analytics_session_id"), number.alias("renamed"))
    columns = list(sessions.SILVER_EVENT_COLUMNS)
    labels = numbered.filter("is_new").select("session_id", "tag", number.alias("analytics_session_id"))
    added = events.join(labels, ["session_id", "tag"], "left").select(*columns)

    ends = [utc_date(F.timestamp_seconds(F.col(c))) for c in ("start", "last")]
    seen = changed.select(F.explode(F.sequence(*ends)).alias("dt"))
    days = _days(events) | _days(seen)
    rows = lh.table(logical).filter(F.col("dt").isin(sorted(days))).join(renamed, "analytics_session_id", "left")
    rows = rows.withColumn("analytics_session_id", F.coalesce("renamed", "analytics_session_id")).select(*columns)
    merged = numbered.groupBy("session_id", F.col("number").alias("ordinal")).agg(
        F.min("start").alias("start"), F.max("last").alias("last"))
    state = spans.join(touched, "session_id", "left_anti").unionByName(merged)
    commit(lh, logical, rows.unionByName(added), days,
           {spans_table: state, _consumed(logical): _taken(lh, logical, batches)})
    return days


# -- everything behind (M14) --------------------------------------------

def refresh_incremental(lh: Lakehouse, as_of: Column | None = None, apply_deletes: bool = False) -> dict[str, Days]:
    """Silver from the new batches only, then the daily marts of the days that changed; sessions and balances whole.

    Returns the changed days of each silver table with days."""
    lh.init()
    changed = {f"silver.{t}": merge_current(lh, t, apply_deletes) for t in ("transactions", "users", "accounts")}
    changed["silver.clickstream_events"] = merge_events(lh)
    both = changed["silver.transactions"] | changed["silver.clickstream_events"]
    for table, build in builds(as_of, apply_deletes, days=both):
        if table in BRONZE:
            continue
        if table in DAILY_BUILDS and table != "gold.sessions":
            replace_days(lh, table, stored(build(lh), "mart_days"), both)
        else:
            lh.publish(table, build(lh))
    return {t: d for t, d in changed.items() if t in ("silver.transactions", "silver.clickstream_events")}
