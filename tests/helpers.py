"""Row builders for unit tests (shapes from FIXTURES.md section 1)."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import types as T

from tidemark import schemas

BRONZE_CDC = schemas.TABLES["bronze.pg_cdc_raw"].schema
BRONZE_CLICKS = schemas.TABLES["bronze.clickstream_raw"].schema


def cdc_row(after, op="c", table="transactions", event_ts=None, partition_id=0, offset=1,
            dt=date(2026, 5, 22), key=None):
    value = {"op": op, "source": {"table": table}}
    if after is not None:
        value["after"] = after
    return {
        "topic": f"wallet.public.{table}", "partition_id": partition_id, "offset_value": offset,
        "key_json": json.dumps({"id": key or (after or {}).get("id")}),
        "value_json": json.dumps(value), "op": op, "source_table": table,
        "event_ts": event_ts, "ingest_ts": datetime(2026, 5, 22, 23, 0, 0),
        "batch_id": 0, "dt": dt,
    }


def bronze_cdc(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in BRONZE_CDC.fields) for r in rows],
                                 BRONZE_CDC)


def click_row(event_id, ts, session_id="session-1", user_id="user-1", event_type="page_enter",
              page="/dashboard", element_id=None, dwell_ms=None, offset=None, partition_id=0,
              x=None, y=None, dt=None):
    return {
        "topic": "clickstream.events", "partition_id": partition_id,
        "offset_value": offset if offset is not None else int(event_id.split("-")[-1]),
        "event_id": event_id, "session_id": session_id, "user_id": user_id,
        "event_type": event_type, "page": page, "element_id": element_id, "x": x, "y": y,
        "dwell_ms": dwell_ms, "value_json": "{}", "event_ts": ts,
        "ingest_ts": datetime(2026, 5, 22, 23, 0, 0), "batch_id": 0,
        "dt": dt or (ts.date() if ts else date(2026, 5, 22)),
    }


def bronze_clicks(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in BRONZE_CLICKS.fields) for r in rows],
                                 BRONZE_CLICKS)


TX_SCHEMA = schemas.TABLES["silver.transactions"].schema
ACCOUNT_SCHEMA = schemas.TABLES["silver.accounts"].schema
EVENT_SCHEMA = schemas.TABLES["silver.clickstream_events"].schema


def frame(spark, schema: T.StructType, rows: list[dict]):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
