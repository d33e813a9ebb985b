import json
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import TX_SCHEMA, bronze_clicks, click_row, frame
from tidemark.operators import bronze as B
from tidemark.operators import clicks, quality

UUID = "3f1c2b9a-7d4e-4c1a-9b2f-0a1b2c3d4e5f"


def test_event_contract(utc):
    t = datetime(2026, 5, 22, 12, 0)
    rows = [
        click_row("e-1", t, user_id=UUID),
        click_row("e-2", t, user_id=UUID, event_type="hover"),
        click_row("e-3", t, user_id=UUID, dwell_ms=-5),
        click_row("e-4", t, user_id="not-a-uuid", session_id=None),
        click_row("e-5", None, user_id=None, page="p" * 241, element_id="x" * 161),
    ]
    got = {r.event_id: r.reasons for r in quality.event_violations(bronze_clicks(utc, rows)).collect()}
    assert got == {"e-1": "", "e-2": "event_type", "e-3": "dwell_ms", "e-4": "session_id,user_id",
                   "e-5": "page,element_id,ts"}


def test_batch_size_rule(utc):
    t = datetime(2026, 5, 22, 12, 0)
    rows = [click_row(f"e-{i}", t, session_id="big") for i in range(201)] + [click_row("e-999", t, session_id="one")]
    got = {r.session_id: (r.events, r.valid) for r in quality.batch_sizes(bronze_clicks(utc, rows), ["session_id"]).collect()}
    assert got == {"big": (201, False), "one": (1, True)}


def test_transaction_contract(utc):
    tx = frame(utc, TX_SCHEMA, [
        {"transaction_id": "ok", "type": "deposit", "amount": Decimal("25.00"), "currency": "USD"},
        {"transaction_id": "bad", "type": "gift", "amount": Decimal("0.00"), "currency": "usd",
         "description": "d" * 241, "merchant": "m" * 121},
        {"transaction_id": "null", "type": None, "amount": None, "currency": None},
    ])
    got = {r.transaction_id: r.reasons for r in quality.transaction_violations(tx).collect()}
    assert got == {"ok": "", "bad": "type,amount,currency,description,merchant", "null": "type,amount,currency"}


def test_dlq_envelope_keeps_original_error_topic(utc):
    dlq = utc.createDataFrame(
        [("clickstream.events", 0, 1, json.dumps({"session_id": "s", "page": "/p"}), "missing_event_id"),
         ("clickstream.events", 0, 2, None, "null_value"),
         ("clickstream.events", 0, 3, 'not {json "x"', "missing_event_id")],
        "topic string, partition_id int, offset_value bigint, raw_value string, error string")
    rows = {r.offset_value: json.loads(r.envelope) for r in B.dlq_envelope(dlq).collect()}
    assert rows[1] == {"original": {"session_id": "s", "page": "/p"}, "error": "missing_event_id",
                       "source_topic": "clickstream.events"}
    assert rows[2]["original"] is None and rows[2]["error"] == "null_value"
    assert rows[3]["original"] == 'not {json "x"'


def test_page_dwell_and_recent_events(utc):
    t = datetime(2026, 5, 22, 12, 0)
    rows = [
        click_row("e-1", t, event_type="page_leave"),
        click_row("e-2", t.replace(second=1), event_type="page_enter"),
        click_row("e-3", t.replace(second=4, microsecond=500000), event_type="page_leave"),
        click_row("e-4", t.replace(second=9), event_type="page_enter", session_id="other"),
    ] + [click_row(f"e-{i}", t.replace(minute=i), event_type="click") for i in range(10, 20)]
    df = bronze_clicks(utc, rows)
    got = {r.event_id: r.dwell_ms for r in clicks.page_dwell(df).collect()}
    assert got == {"e-1": None, "e-3": 3500}
    recent = clicks.recent_events(df).filter(F.col("session_id") == "session-1").orderBy("rank").collect()
    assert [r.event_id for r in recent] == [f"e-{i}" for i in range(19, 11, -1)]


def test_strict_split_dead_letters_contract_breaks(utc):
    env = utc.createDataFrame([
        ("clickstream.events", 0, 1, None, json.dumps({"event_id": "a", "session_id": "s", "event_type": "click",
                                                       "page": "/p", "ts": "2026-05-22T12:00:00Z"})),
        ("clickstream.events", 0, 2, None, json.dumps({"event_id": "b", "session_id": "s", "event_type": "hover",
                                                       "page": "/p", "dwell_ms": -5, "ts": "2026-05-22T12:00:00Z"})),
        ("clickstream.events", 0, 3, None, json.dumps({"session_id": "s"})),
    ], "topic string, partition_id int, offset_value bigint, key_json string, value_json string")
    lax_valid, lax_dlq = B.split_clicks(B.annotate_clicks(env))
    assert lax_valid.count() == 2 and lax_dlq.count() == 1
    valid, dlq = B.split_clicks(B.annotate_clicks(env), strict=True)
    assert [r.offset_value for r in valid.collect()] == [1]
    assert {r.offset_value: r.error for r in dlq.collect()} == {
        2: "contract:event_type,dwell_ms", 3: "missing_event_id"}


def test_strict_split_checks_types_of_the_raw_text(utc):
    base = {"event_id": "a", "session_id": "s", "event_type": "click", "page": "/p", "ts": "2026-05-22T12:00:00Z"}
    extras = [{"dwell_ms": 12, "x": 3, "y": -4}, {"dwell_ms": "abc"}, {"x": "q"}, {"dwell_ms": 12.7},
              {"y": 10 ** 30}, {"dwell_ms": "7", "x": 5.0}, {"dwell_ms": None}]
    env = utc.createDataFrame(
        [("clickstream.events", 0, i, None, json.dumps(base | e)) for i, e in enumerate(extras)],
        "topic string, partition_id int, offset_value bigint, key_json string, value_json string")
    valid, dlq = B.split_clicks(B.annotate_clicks(env), strict=True)
    assert sorted(r.offset_value for r in valid.collect()) == [0, 5, 6]
    assert {r.offset_value: r.error for r in dlq.collect()} == {
        1: "contract:dwell_ms", 2: "contract:x", 3: "contract:dwell_ms", 4: "contract:y"}


def _batch(n, offset):
    events = [json.dumps({"event_id": f"{offset}-{i}", "page": "/p"}) for i in range(n)]
    return ("clickstream.batches", 0, offset, '{"events":[' + ",".join(events) + "]}")


def test_batches_of_events(utc):
    rows = [_batch(0, 0), _batch(1, 1), _batch(200, 2), _batch(201, 3), ("clickstream.batches", 0, 4, "{}"),
            ("clickstream.batches", 0, 5, None), ("clickstream.batches", 0, 6, "no json"), ("clickstream.batches", 0, 7, '{"events": 7}')]
    batches = utc.createDataFrame(rows, "topic string, partition_id int, offset_value bigint, value_json string")
    got = {r.offset_value: (r.events, r.reasons, r.valid) for r in quality.batch_violations(batches).collect()}
    assert got == {0: (0, "empty", False), 1: (1, "", True), 2: (200, "", True), 3: (201, "too_long", False),
                   **{k: (None, "events", False) for k in (4, 5, 6, 7)}}
    events, refused = quality.split_batches(batches)
    found = {(r.offset_value, r.position): json.loads(r.value_json)["event_id"] for r in events.collect()}
    assert found == {(1, 0): "1-0", **{(2, i): f"2-{i}" for i in range(200)}}
    assert {r.offset_value: r.error for r in refused.collect()} == {
        0: "batch:empty", 3: "batch:too_long", **{k: "batch:events" for k in (4, 5, 6, 7)}}
    assert B.split_clicks(B.annotate_clicks(events))[0].count() == 201  # envelopes like any other


def test_digits_of_raw_amounts(utc):
    texts = {"1.005": True, "1.50": False, "1.500": False, "0012.3": False, "1234567890123456.78": False, "12345678901234567": True,
             "1e3": False, "1.5e-3": True, "+7": False, "1E40": True, "abc": True, None: False}
    tx = utc.createDataFrame([(str(i), "deposit", Decimal("1.00"), "EUR", None, None, t) for i, t in enumerate(texts)],
                             "transaction_id string, type string, amount decimal(18,2), currency string, description string, merchant string, raw string")
    got = {int(r.transaction_id): r.reasons for r in quality.transaction_violations(tx, "raw").collect()}
    assert got == {i: "digits" if broken else "" for i, broken in enumerate(texts.values())}


def test_event_contract_checks_types_of_the_raw_text(utc):
    t = datetime(2026, 5, 22, 12, 0)
    rows = [click_row("e-1", t, user_id=None) | {"value_json": '{"x": "q", "dwell_ms": 1.5}'},
            click_row("e-2", t, user_id=None, x=3) | {"value_json": '{"x": 3}'}]
    got = {r.event_id: r.reasons for r in quality.event_violations(bronze_clicks(utc, rows)).collect()}
    assert got == {"e-1": "x,dwell_ms", "e-2": ""}
