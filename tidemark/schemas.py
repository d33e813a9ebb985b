"""Registry of the lakehouse tables: schema, partition columns, namespace.

Bronze tables are append-only; silver and gold tables are rebuilt. Bronze
tables carry a ``batch_id`` partition beside ``dt`` so that a retried
micro-batch replaces exactly its own rows (idempotent ingest).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
D = T.DoubleType()
TS = T.TimestampType()
DT = T.DateType()
MONEY = T.DecimalType(18, 2)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


@dataclass(frozen=True)
class TableSpec:
    namespace: str
    name: str
    schema: T.StructType
    partition_by: tuple[str, ...] = ()

    @property
    def qualified(self) -> str:
        return f"{self.namespace}.{self.name}"

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]


# Texts that differ in nearly every row: a dictionary of them is built, given up and written as plain text.
NO_DICTIONARY = ("key_json", "value_json", "raw_value", "event_id", "transaction_id")


def write_options(spec: TableSpec) -> dict[str, str]:
    """The options of a table's Parquet files."""
    return {f"parquet.enable.dictionary#{c}": "false" for c in spec.columns if c in NO_DICTIONARY}


# Bronze rows are keyed by the writing ingest (a stable id of its checkpoint)
# and its micro-batch, so a retried batch replaces exactly its own rows.
BRONZE_PARTITIONS = ("ingest_id", "batch_id", "dt")
# The CDC table is also split by source table: each silver build reads only
# its own table's folders (partition pruning) instead of all change rows.
STATIC_BRONZE_PARTITIONS = ("ingest_id", "batch_id")

SESSION_FIELDS = (
    ("session_id", S), ("raw_session_id", S), ("user_id", S),
    ("started_at", TS), ("ended_at", TS), ("events_count", L),
    ("total_dwell_ms", L), ("dt", DT),
)

TABLES: dict[str, TableSpec] = {
    spec.qualified: spec
    for spec in [
        TableSpec("bronze", "pg_cdc_raw", _schema(
            ("topic", S), ("partition_id", I), ("offset_value", L), ("key_json", S),
            ("value_json", S), ("op", S), ("event_ts", TS), ("ingest_ts", TS),
            ("ingest_id", S), ("batch_id", L), ("source_table", S), ("dt", DT)),
            ("ingest_id", "batch_id", "source_table", "dt")),
        TableSpec("bronze", "dlq_pg_cdc", _schema(
            ("topic", S), ("partition_id", I), ("offset_value", L), ("key_json", S),
            ("raw_value", S), ("error", S), ("ingest_ts", TS), ("ingest_id", S), ("batch_id", L),
            ("dt", DT)), BRONZE_PARTITIONS),
        TableSpec("bronze", "dlq_clickstream", _schema(
            ("topic", S), ("partition_id", I), ("offset_value", L), ("raw_value", S),
            ("error", S), ("ingest_ts", TS), ("ingest_id", S), ("batch_id", L), ("dt", DT)), BRONZE_PARTITIONS),
        TableSpec("bronze", "clickstream_raw", _schema(
            ("topic", S), ("partition_id", I), ("offset_value", L), ("event_id", S),
            ("session_id", S), ("user_id", S), ("event_type", S), ("page", S),
            ("element_id", S), ("x", I), ("y", I), ("dwell_ms", L), ("value_json", S),
            ("event_ts", TS), ("ingest_ts", TS), ("ingest_id", S), ("batch_id", L), ("dt", DT)), BRONZE_PARTITIONS),
        TableSpec("silver", "transactions", _schema(
            ("transaction_id", S), ("user_id", S), ("account_id", S), ("type", S),
            ("direction", S), ("amount", MONEY), ("currency", S), ("description", S),
            ("merchant", S), ("balance_after", MONEY), ("occurred_at", TS),
            ("created_at", TS), ("dt", DT)), ("dt",)),
        TableSpec("silver", "users", _schema(
            ("user_id", S), ("full_name", S), ("email", S), ("created_at", TS),
            ("event_ts", TS))),
        TableSpec("silver", "accounts", _schema(
            ("account_id", S), ("user_id", S), ("currency", S), ("opening_balance", MONEY),
            ("current_balance", MONEY), ("created_at", TS), ("updated_at", TS),
            ("event_ts", TS))),
        TableSpec("silver", "clickstream_events", _schema(
            ("event_id", S), ("session_id", S), ("analytics_session_id", S), ("user_id", S),
            ("event_type", S), ("page", S), ("element_id", S), ("x", I), ("y", I),
            ("dwell_ms", L), ("event_ts", TS), ("dt", DT)), ("dt",)),
        TableSpec("silver", "sessions", _schema(*SESSION_FIELDS), ("dt",)),
        TableSpec("gold", "current_balances", _schema(
            ("user_id", S), ("account_id", S), ("currency", S), ("balance", MONEY),
            ("transactions_count", L), ("updated_at", TS))),
        TableSpec("gold", "transaction_volume_daily", _schema(
            ("dt", DT), ("user_id", S), ("currency", S), ("credit_amount", MONEY),
            ("debit_amount", MONEY), ("transaction_count", L)), ("dt",)),
        TableSpec("gold", "page_engagement_daily", _schema(
            ("dt", DT), ("page", S), ("sessions", L), ("events", L),
            ("total_dwell_ms", L), ("avg_dwell_ms", D)), ("dt",)),
        TableSpec("gold", "button_clicks_daily", _schema(
            ("dt", DT), ("page", S), ("element_id", S), ("clicks", L), ("users", L),
            ("sessions", L)), ("dt",)),
        TableSpec("gold", "conversion_funnel_daily", _schema(
            ("dt", DT), ("page_views", L), ("create_transaction_clicks", L),
            ("transactions_created", L), ("conversion_rate", D)), ("dt",)),
        TableSpec("gold", "conversion_funnel_cta_daily", _schema(
            ("dt", DT), ("element_id", S), ("clicks", L), ("users", L), ("sessions", L)), ("dt",)),
        TableSpec("gold", "user_engagement_daily", _schema(
            ("dt", DT), ("user_id", S), ("sessions", L), ("total_dwell_ms", L),
            ("page_views", L), ("clicks", L), ("transactions_count", L),
            ("debit_amount", MONEY), ("credit_amount", MONEY)), ("dt",)),
        TableSpec("gold", "sessions", _schema(*SESSION_FIELDS), ("dt",)),
    ]
}

NAMESPACES = ("bronze", "silver", "gold")

# What incremental refreshes remember beside the tables above: the bronze
# batches a silver table has taken in, the position of the change that each
# key's row comes from, and the spans of the sessions of each raw session.
CONSUMED = _schema(("ingest_id", S), ("batch_id", L))
POSITIONS = _schema(("key", S), ("event_ts", TS), ("partition_id", I), ("offset_value", L), ("old_dt", DT))
SPANS = _schema(("session_id", S), ("start", L), ("last", L), ("ordinal", L))
STATE_TABLES: dict[str, TableSpec] = {
    spec.qualified: spec
    for spec in [
        *(TableSpec("state", f"{t}_consumed", CONSUMED)
          for t in ("transactions", "users", "accounts", "clickstream_events")),
        *(TableSpec("state", f"{t}_positions", POSITIONS) for t in ("transactions", "users", "accounts")),
        TableSpec("state", "session_spans", SPANS),
        TableSpec("state", "column_statistics", _schema(
            ("table_name", S), ("dt", DT), ("column", S), ("rows", L), ("nulls", L), ("low", T.DecimalType(38, 6)),
            ("high", T.DecimalType(38, 6)), ("low_text", S), ("high_text", S), ("sketch", T.BinaryType()))),
    ]
}


def spec(name: str) -> TableSpec:
    return TABLES.get(name) or STATE_TABLES[name]
