"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each query reads the test tables in ``sf_dir`` and runs the whole chain
(adapter -> bronze -> silver -> gold) as one lazy plan. Instants leave as
UTC wall-clock ``TIMESTAMP_NTZ`` so results do not depend on the session
time zone; non-deterministic columns (``ingest_ts``, ``updated_at``) and raw
JSON text are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeparse import timestamp_from_text, utc_wall_clock
from tidemark.operators import cdc, marts, sessions
from tidemark.operators import bronze as B
from tidemark.plans.layers import Layers

Query = Callable[[SparkSession, str], DataFrame]


def edge(df: DataFrame) -> DataFrame:
    """Instants -> UTC wall clock (TIMESTAMP_NTZ) at the query edge."""
    return df.select(*[
        utc_wall_clock(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


CLICK_COLUMNS = ("topic", "partition_id", "offset_value", "event_id", "session_id", "user_id",
                 "event_type", "page", "element_id", "x", "y", "dwell_ms", "event_ts", "dt")
CDC_COLUMNS = ("topic", "partition_id", "offset_value", "key_json", "op", "source_table",
               "event_ts", "dt")


def click_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge(Layers(spark, sf_dir).bronze_clicks.select(*CLICK_COLUMNS))


def click_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Layers(spark, sf_dir).dlq_clicks.select("topic", "partition_id", "offset_value", "error")


def cdc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge(Layers(spark, sf_dir).bronze_cdc.select(*CDC_COLUMNS))


def cdc_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Layers(spark, sf_dir).dlq_cdc.select("topic", "partition_id", "offset_value", "key_json", "error")


def cdc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.change_counts(Layers(spark, sf_dir).bronze_cdc)


def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 ladder on every transaction version text (millis and ISO mixed)."""
    changes = cdc.cdc_changes(Layers(spark, sf_dir).parsed_changes("transactions"), "transactions")
    return edge(changes.select(
        F.col("key").alias("transaction_id"), "op",
        timestamp_from_text(F.col("a_occurred_at")).alias("occurred_at"),
        timestamp_from_text(F.col("a_created_at")).alias("created_at"),
        "event_ts",
    ))


def _layer(attr: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return edge(getattr(Layers(spark, sf_dir), attr))
    run.__name__ = attr
    return run


def silver_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge(Layers(spark, sf_dir).transactions_of())


def silver_transactions_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge(cdc.silver_transactions(Layers(spark, sf_dir).parsed_changes("transactions"), apply_deletes=True))


def sessionize_long_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 with an 8 h idle gap, so that both split branches are exercised."""
    events = sessions.sessionize(Layers(spark, sf_dir).clicks, gap_seconds=8 * 3600)
    return events.select("event_id", "analytics_session_id")


def gold_current_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Layers(spark, sf_dir).current_balances().drop("updated_at")


def active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    L = Layers(spark, sf_dir)
    return marts.active_days(L.events, L.transactions_of("dt"))


def engagement_latest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.latest_days(Layers(spark, sf_dir).user_engagement_daily, 10)


# -- streaming keys ------------------------------------------------------

def stream_click_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream -> foreachBatch -> bronze (+DLQ); read back."""
    from tidemark.streaming import ingest
    lh = ingest.fresh_lakehouse(spark, "stream-clicks")
    q = ingest.start_bronze_ingest(ingest.click_envelope_stream(spark, sf_dir), "clicks", lh)
    ingest.run_to_completion(q)
    return edge(lh.table("bronze.clickstream_raw").select(*CLICK_COLUMNS))


def stream_cdc_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer + orders as file streams -> CDC envelopes -> bronze (+DLQ)."""
    from tidemark.streaming import ingest
    lh = ingest.fresh_lakehouse(spark, "stream-cdc")
    q = ingest.start_bronze_ingest(ingest.cdc_envelope_stream(spark, sf_dir), "cdc", lh)
    ingest.run_to_completion(q)
    return edge(lh.table("bronze.pg_cdc_raw").select(*CDC_COLUMNS))


# -- catalog / pipeline keys ----------------------------------------------

def _refreshed(spark: SparkSession, sf_dir: str, label: str):
    from tidemark.plans import refresh
    from tidemark.sources import testdata
    from tidemark.streaming import ingest
    lh = ingest.fresh_lakehouse(spark, label)
    refresh.load_bronze_batch(lh, testdata.cdc_envelopes(spark, sf_dir),
                              testdata.click_envelopes(spark, sf_dir), load_id="tables")
    refresh.refresh_all(lh, parallel=4)
    return lh


def check_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 after a full ingest + refresh (M14): all 17 tables with row counts."""
    lh = _refreshed(spark, sf_dir, "check")
    return lh.check_tables().select(
        F.regexp_replace("table", r"^tm[0-9a-f]+_", "").alias("table"), "status", "rows")


def check_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.catalog import REQUIRED_NONEMPTY
    lh = _refreshed(spark, sf_dir, "nonempty")
    return lh.check_nonempty(REQUIRED_NONEMPTY).select(
        F.regexp_replace("table", r"^tm[0-9a-f]+_", "").alias("table"), "status", "rows", "nonempty")


def gold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11/L2: read a gold table by name after the refresh; ordered preview."""
    lh = _refreshed(spark, sf_dir, "scan")
    lh.refresh(["gold.page_engagement_daily"])
    return lh.preview("gold.page_engagement_daily", 10, ["dt", "page"])


def overwrite_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuild gold.transaction_volume_daily in dynamic mode from the
    first half of the month only; later days keep their (stale) rows, the
    rewritten days are replaced. The table is read back whole."""
    from tidemark.streaming import ingest
    lh = ingest.fresh_lakehouse(spark, "overwrite")
    lh.init(["gold.transaction_volume_daily"])
    L = Layers(spark, sf_dir)
    full = marts.transaction_volume_daily(L.transactions)
    lh.overwrite("gold.transaction_volume_daily", full, mode="dynamic")
    amended = marts.transaction_volume_daily(
        L.transactions.filter(F.col("dt") <= F.lit("2024-01-15").cast("date"))
        .withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)")))
    lh.overwrite("gold.transaction_volume_daily", amended, mode="dynamic")
    return lh.table("gold.transaction_volume_daily")


# -- re-aimed service rules (V1-V14) ---------------------------------------

def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import quality
    return quality.event_violations(Layers(spark, sf_dir).bronze_clicks)


def normalize_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import clicks
    return clicks.normalized_times(Layers(spark, sf_dir).bronze_clicks)


def validate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 with batches = (raw session, minute): the tracker flushes a
    session's queue every few seconds, so a minute holds whole requests."""
    from tidemark.operators import quality
    events = Layers(spark, sf_dir).bronze_clicks
    return edge(quality.batch_sizes(
        events, ["session_id", F.date_trunc("minute", "event_ts").alias("batch_start")]))


def validate_batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 on batch records that hold lists of events."""
    from tidemark.operators import quality
    from tidemark.sources import testdata
    batches = testdata.click_batches(testdata.read_table(spark, sf_dir, "events"))
    return quality.batch_violations(batches).drop("topic", "partition_id")


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of all batches that keep V3, parsed, with their positions."""
    from tidemark.operators import quality
    from tidemark.sources import testdata
    batches = testdata.click_batches(testdata.read_table(spark, sf_dir, "events"))
    events, _ = quality.split_batches(batches)
    return events.select("offset_value", "position", F.get_json_object("value_json", "$.event_id").alias("event_id"))


def rolling_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 merged: distinct users of the last seven days, from bitmaps per day."""
    from tidemark.operators import distinct
    from tidemark.session import stored
    events = Layers(spark, sf_dir).events.select("dt", "user_id")
    codes = stored(distinct.new_codes(events.select("user_id")), "user_codes")
    return distinct.rolling_users(events, codes)


def dlq_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = B.dlq_envelope(Layers(spark, sf_dir).dlq_clicks)
    return env.select(
        "offset_value",
        F.get_json_object("envelope", "$.error").alias("error"),
        F.get_json_object("envelope", "$.source_topic").alias("source_topic"),
        F.get_json_object("envelope", "$.original.session_id").alias("original_session_id"),
    )


def tx_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import ledger
    return ledger.tx_direction(Layers(spark, sf_dir).transactions_of("transaction_id", "type", "direction"))


def validate_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import quality
    L = Layers(spark, sf_dir)
    raw = cdc.latest_images(L.parsed_changes("transactions"), "transactions").select(*cdc.silver_columns("transactions"), "a_amount")
    return quality.transaction_violations(raw, "a_amount")


def first_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import ledger
    return edge(ledger.first_account(Layers(spark, sf_dir).accounts))


def recent_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8 with n = 5 (API range 1..100) so that the limit cuts at this scale."""
    from tidemark.operators import ledger
    return edge(ledger.recent_transactions(
        Layers(spark, sf_dir).transactions_of("user_id", "transaction_id", "created_at", "amount", "direction"), 5))


def list_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import ledger
    return edge(ledger.list_users(Layers(spark, sf_dir).users))


def _some_accounts(L: Layers) -> DataFrame:
    """The accounts without those whose id ends in 3: their transactions name no account."""
    return L.accounts.filter(~F.col("account_id").endswith("3"))


LEDGER_COLUMNS = ("transaction_id", "user_id", "currency", "occurred_at", "direction", "amount")


def ledger_running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import ledger
    L = Layers(spark, sf_dir)
    return edge(ledger.ledger_running_balance(L.transactions_of(*LEDGER_COLUMNS), _some_accounts(L)))


def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import ledger
    L = Layers(spark, sf_dir)
    return edge(ledger.ledger_replay(L.transactions_of(*LEDGER_COLUMNS), _some_accounts(L)))


def resolve_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import ledger
    L = Layers(spark, sf_dir)
    return ledger.resolve_accounts(L.transactions_of("transaction_id", "account_id", "user_id", "currency"), L.accounts)


def page_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import clicks
    return clicks.page_dwell(Layers(spark, sf_dir).clicks)


def income_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import ledger
    return ledger.income_spend(Layers(spark, sf_dir).transactions_of("user_id", "direction", "amount"))


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import clicks
    return clicks.recent_events(Layers(spark, sf_dir).bronze_clicks)


# -- remaining survey keys ---------------------------------------------------

def bronze_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: Kafka-shaped records (binary key/value) -> envelope text columns."""
    from tidemark.sources.kafka import decode_envelope
    env = Layers(spark, sf_dir).click_envelopes
    records = env.select(
        "topic", F.col("partition_id").alias("partition"), F.col("offset_value").alias("offset"),
        F.col("key_json").cast("binary").alias("key"), F.col("value_json").cast("binary").alias("value"))
    decoded = decode_envelope(records)
    return decoded.select("topic", "partition_id", "offset_value", "key_json",
                          F.get_json_object("value_json", "$.event_id").alias("event_id"))


def event_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bronze date of every valid CDC and click record."""
    L = Layers(spark, sf_dir)
    cols = ["topic", "partition_id", "offset_value", "dt"]
    return L.bronze_cdc.select(*cols).unionByName(L.bronze_clicks.select(*cols))


def session_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_flags(Layers(spark, sf_dir).clicks)


def cdc_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge(cdc.latest_changes(Layers(spark, sf_dir).bronze_cdc))


def refresh_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12/C13 after a full refresh: refresh + ANALYZE each gold table, then
    report the row count the statistics recorded."""
    from tidemark.plans.catalog import GOLD_TABLES
    lh = _refreshed(spark, sf_dir, "refresh")
    status = lh.refresh(GOLD_TABLES)
    stats = []
    for logical in GOLD_TABLES:
        desc = spark.sql(f"DESCRIBE TABLE EXTENDED {lh.name(logical)}").filter(F.col("col_name") == "Statistics")
        stats.append(desc.select(F.lit(lh.name(logical)).alias("table"), F.regexp_extract(
            "data_type", r"([0-9]+) rows", 1).cast("bigint").alias("rows")))
    rows = stats[0]
    for d in stats[1:]:
        rows = rows.unionByName(d)
    return status.join(rows, "table").select(
        F.regexp_replace("table", r"^tm[0-9a-f]+_", "").alias("table"), "refresh", "analyze", "rows")


def ledger_replay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11 as a stream: current transactions are written to a folder, read
    back as a file stream, replayed with state by groups of accounts, and the
    sink table is returned. A heartbeat behind the last transaction moves the
    watermark past all of them."""
    from tidemark.plans.catalog import setting
    from tidemark.session import shared_path, stored
    from tidemark.streaming import ledger as stream_ledger
    L = Layers(spark, sf_dir)
    folder = shared_path(spark, "runs", "ledger-stream", unique=True)
    tx = L.transactions_of(*LEDGER_COLUMNS)
    tx.write.parquet(f"{folder}/in")
    tx = spark.read.schema(tx.schema).parquet(f"{folder}/in")
    last = tx.agg(F.max("occurred_at").alias("last")).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "occurred_at" else
          (F.col("last") + F.expr("INTERVAL 3 DAYS")).alias("occurred_at") for f in tx.schema.fields])
    last.write.mode("append").parquet(f"{folder}/in")
    # Every micro-batch joins them: written once.
    accounts = stored(_some_accounts(L), "ledger_accounts")
    before = stream_ledger.use_rocksdb_state(spark)
    try:
        source = spark.readStream.schema(tx.schema).parquet(f"{folder}/in")
        query = (stream_ledger.ledger_replay_stream(source, accounts, "1 day", 86_400).writeStream
                 .format("parquet").option("path", f"{folder}/out")
                 .option("checkpointLocation", f"{folder}/checkpoint")
                 .trigger(availableNow=True))
        with setting(spark, "spark.sql.shuffle.partitions", str(stream_ledger.state_partitions(spark))):
            query = query.start()
            query.awaitTermination()
    finally:
        stream_ledger.restore_state_store(spark, before)
    return edge(spark.read.parquet(f"{folder}/out"))


def refresh_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 end to end on written tables: ingest to bronze, run the thirteen
    builds, read gold.user_engagement_daily back from the catalog."""
    lh = _refreshed(spark, sf_dir, "refresh-all")
    return lh.table("gold.user_engagement_daily")


def registry() -> dict[str, Query]:
    return {
        "click_parse": click_parse,
        "click_dlq": click_dlq,
        "cdc_parse": cdc_parse,
        "cdc_dlq": cdc_dlq,
        "cdc_filter": cdc_filter,
        "parse_timestamps": parse_timestamps,
        "silver_transactions": silver_transactions,
        "silver_transactions_live": silver_transactions_live,
        "silver_users": _layer("users"),
        "silver_accounts": _layer("accounts"),
        "silver_clickstream_events": _layer("events"),
        "sessionize": sessionize_long_gap,
        "silver_sessions": _layer("sessions"),
        "gold_sessions": _layer("gold_sessions"),
        "gold_current_balances": gold_current_balances,
        "gold_transaction_volume_daily": _layer("transaction_volume_daily"),
        "gold_page_engagement_daily": _layer("page_engagement_daily"),
        "gold_button_clicks_daily": _layer("button_clicks_daily"),
        "gold_conversion_funnel_daily": _layer("conversion_funnel_daily"),
        "gold_conversion_funnel_cta_daily": _layer("conversion_funnel_cta_daily"),
        "gold_user_engagement_daily": _layer("user_engagement_daily"),
        "active_days": active_days,
        "engagement_latest_days": engagement_latest_days,
        "stream_click_bronze": stream_click_bronze,
        "stream_cdc_bronze": stream_cdc_bronze,
        "check_tables": check_tables,
        "check_nonempty": check_nonempty,
        "gold_scan": gold_scan,
        "overwrite_partitions": overwrite_partitions,
        "validate_events": validate_events,
        "normalize_ts": normalize_ts,
        "validate_batches": validate_batches,
        "validate_batch_records": validate_batch_records,
        "batch_events": batch_events,
        "rolling_users": rolling_users,
        "dlq_envelope": dlq_envelope,
        "tx_direction": tx_direction,
        "validate_transactions": validate_transactions,
        "first_account": first_account,
        "recent_transactions": recent_transactions,
        "list_users": list_users,
        "ledger_running_balance": ledger_running_balance,
        "ledger_replay": ledger_replay,
        "resolve_accounts": resolve_accounts,
        "page_dwell": page_dwell,
        "income_spend": income_spend,
        "recent_events": recent_events,
        "bronze_envelope": bronze_envelope,
        "event_date": event_date,
        "session_flags": session_flags,
        "cdc_latest": cdc_latest,
        "refresh_gold": refresh_gold,
        "ledger_replay_stream": ledger_replay_stream,
        "refresh_all": refresh_all,
    }
