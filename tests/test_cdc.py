import json
import random
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from helpers import bronze_cdc, cdc_row
from tidemark.operators import bronze as B
from tidemark.operators import cdc

TX = {
    "id": "tx-1", "user_id": "ann", "account_id": "acc-ann-eur", "type": "transfer_out",
    "direction": "debit", "amount": "310.07", "currency": "EUR", "merchant": None,
    "occurred_at": "2025-02-28T23:59:59.5+02:00", "created_at": "1740779999000",
}


def test_the_business_date_is_the_utc_day_of_the_event(utc):
    """Text with an offset, milliseconds as text, and one that crosses midnight, whatever day bronze has."""
    times = {"a": ("2025-02-28T23:59:59.5+02:00", date(2025, 2, 28)), "b": ("2025-02-28T23:59:59-01:00", date(2025, 3, 1)),
             "c": ("1709251199999", date(2024, 2, 29)), "d": ("1709251200000", date(2024, 3, 1))}
    rows = [cdc_row(dict(TX, id=k, occurred_at=text), event_ts=datetime(2025, 7, 1), offset=i, dt=date(2025, 7, 1))
            for i, (k, (text, _)) in enumerate(times.items())]
    out = cdc.silver_transactions(bronze_cdc(utc, rows)).collect()
    assert {r.transaction_id: r.dt for r in out} == {k: day for k, (_, day) in times.items()}
    assert {r.amount for r in out} == {Decimal("310.07")}


def test_dt_falls_back_to_bronze_date(utc):
    after = dict(TX, occurred_at="garbage")
    rows = [cdc_row(after, event_ts=datetime(2026, 5, 22, 10, 0), dt=date(2026, 5, 21))]
    assert cdc.silver_transactions(bronze_cdc(utc, rows)).first().dt == date(2026, 5, 21)


def test_the_latest_change_wins_in_any_order_of_arrival(utc):
    """Random versions of several keys, delivered shuffled: the greatest (time, partition, offset) stays."""
    rnd = random.Random(21)
    rows = [cdc_row(dict(TX, id=f"k{i % 9}", description=str(i)), op=rnd.choice("cru"), partition_id=i % 2, offset=1000 - i,
                    event_ts=datetime(2025, 4, 1, rnd.randrange(3))) for i in range(120)]
    best = {}
    for row in rows:
        after = json.loads(row["value_json"])["after"]
        place = (row["event_ts"], row["partition_id"], row["offset_value"])
        best[after["id"]] = max(best.get(after["id"], (place, "")), (place, after["description"]))
    rnd.shuffle(rows)
    out = cdc.silver_transactions(bronze_cdc(utc, rows)).collect()
    assert {r.transaction_id: r.description for r in out} == {k: text for k, (_, text) in best.items()}


def test_ties_break_on_partition_then_offset_and_null_ts_loses(utc):
    ts = datetime(2026, 5, 22, 10, 0)
    rows = [
        cdc_row(dict(TX, description="p1-o5"), event_ts=ts, partition_id=1, offset=5),
        cdc_row(dict(TX, description="p1-o9"), event_ts=ts, partition_id=1, offset=9),
        cdc_row(dict(TX, description="p0-o99"), event_ts=ts, partition_id=0, offset=99),
        cdc_row(dict(TX, description="null-ts"), event_ts=None, partition_id=9, offset=999),
    ]
    assert cdc.silver_transactions(bronze_cdc(utc, rows)).first().description == "p1-o9"


def test_deletes_ignored_by_default_applied_on_request(utc):
    rows = [
        cdc_row(TX, op="c", event_ts=datetime(2026, 5, 22, 10, 0), offset=1),
        cdc_row(None, op="d", event_ts=datetime(2026, 5, 22, 11, 0), offset=2, key="tx-1"),
    ]
    df = bronze_cdc(utc, rows)
    assert cdc.silver_transactions(df).count() == 1
    assert cdc.silver_transactions(df, apply_deletes=True).count() == 0


def test_other_tables_and_missing_key_are_filtered(utc):
    rows = [
        cdc_row(TX, event_ts=datetime(2026, 5, 22, 10, 0)),
        cdc_row(dict(TX, id=None), event_ts=datetime(2026, 5, 22, 10, 0), offset=2),
        cdc_row({"id": "u-1", "full_name": "A", "email": "a@x", "created_at": "2026-01-01T00:00:00Z"},
                table="users", op="r", event_ts=datetime(2026, 5, 22, 10, 0), offset=3),
    ]
    df = bronze_cdc(utc, rows)
    assert cdc.silver_transactions(df).count() == 1
    users = cdc.silver_users(df).collect()
    assert [(u.user_id, u.created_at) for u in users] == [("u-1", datetime(2026, 1, 1))]


def test_amount_overflow_and_half_up(utc):
    rows = [
        cdc_row(dict(TX, id="a", amount="1.005"), event_ts=datetime(2026, 5, 22, 10, 0), offset=1),
        cdc_row(dict(TX, id="b", amount="12345678901234567890.00"), event_ts=datetime(2026, 5, 22, 10, 0), offset=2),
    ]
    got = {r.transaction_id: r.amount for r in cdc.silver_transactions(bronze_cdc(utc, rows)).collect()}
    assert got == {"a": Decimal("1.01"), "b": None}


def test_split_by_op_and_value(utc):
    envelope = utc.createDataFrame([
        ("wallet.public.transactions", 0, 1, '{"id":"t"}', '{"op":"c","ts_ms":1779442245000,"source":{"table":"transactions"}}'),
        ("wallet.public.transactions", 0, 2, '{"id":"t"}', '{"ts_ms":1779442245000,"source":{"table":"transactions"}}'),
        ("wallet.public.transactions", 0, 3, '{"id":"t"}', None),
        ("wallet.public.transactions", 0, 4, '{"id":"t"}', "not json at all"),
    ], "topic string, partition_id int, offset_value bigint, key_json string, value_json string")
    valid, dlq = B.split_cdc(B.annotate_cdc(envelope))
    v = valid.collect()
    assert [(r.offset_value, r.op, r.source_table) for r in v] == [(1, "c", "transactions")]
    assert v[0].event_ts == datetime(2026, 5, 22, 9, 30, 45) and v[0].dt == date(2026, 5, 22)
    errors = {r.offset_value: r.error for r in dlq.collect()}
    assert errors == {2: "missing_debezium_op", 3: "null_value", 4: "missing_debezium_op"}


def test_empty_op_counts_as_present(utc):
    envelope = utc.createDataFrame(
        [("t", 0, 1, None, '{"op":"","ts_ms":"1","source":{"table":"users"}}')],
        "topic string, partition_id int, offset_value bigint, key_json string, value_json string")
    valid, dlq = B.split_cdc(B.annotate_cdc(envelope))
    assert valid.count() == 1 and dlq.count() == 0


def test_change_counts(utc):
    rows = [
        cdc_row(TX, op="c", event_ts=datetime(2026, 5, 22, 10, 0), offset=1),
        cdc_row(TX, op="u", event_ts=datetime(2026, 5, 22, 10, 1), offset=2),
        cdc_row(None, op="d", event_ts=datetime(2026, 5, 22, 10, 2), offset=3, key="tx-1"),
    ]
    got = {(r.source_table, r.op): r.rows for r in cdc.change_counts(bronze_cdc(utc, rows)).collect()}
    assert got == {("transactions", "c"): 1, ("transactions", "u"): 1, ("transactions", "d"): 1}


def test_latest_per_key_plan_has_no_window(utc):
    rows = [cdc_row(TX, event_ts=datetime(2026, 5, 22, 10, 0))]
    plan = cdc.silver_transactions(bronze_cdc(utc, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "partial" in plan.lower() or "Partial" in plan


def test_repeated_json_key_takes_the_last_value(utc):
    envelope = utc.createDataFrame(
        [("t", 0, 1, None, '{"op":"c","op":"u","ts_ms":"1","source":{"table":"users"}}')],
        "topic string, partition_id int, offset_value bigint, key_json string, value_json string")
    assert B.annotate_cdc(envelope).first().op == "u"


def test_an_image_parsed_with_the_header_gives_the_rows_of_a_second_parse(utc):
    """Odd records too: an image or source that is no object, a broken text, a repeated name, a nested value, no image."""
    texts = [json.dumps({"op": "c", "ts_ms": 1000 + i, "source": {"table": "transactions"}, "after": after}) for i, after in enumerate(
        [TX, dict(TX, id="n", amount={"a": [1]}), dict(TX, id=7, direction=None), "text", [TX], None, {}, dict(TX, id=None)])]
    texts += ['{"op":"u","ts_ms":"x","source":"transactions","after":{"id":"s"}}', '{"op":"c","source":{"table":"transactions"},"after":{"id":"b"',
              '{"op":"c","source":{"table":"transactions"},"after":{"id":"1st"},"after":{"id":"2nd"}}', "no json", None,
              '{"op":"d","ts_ms":1,"source":{"table":"transactions"},"before":{"id":"k"}}', '{"source":{"table":"transactions"},"after":{"id":"o"}}']
    envelope = utc.createDataFrame([("wallet.public.transactions", 0, i, '{"id":"k"}', t) for i, t in enumerate(texts)],
                                   "topic string, partition_id int, offset_value bigint, key_json string, value_json string")
    now = F.lit(datetime(2026, 5, 22)).cast("timestamp")
    twice = B.split_cdc(B.annotate_cdc(envelope, now))
    once = B.split_cdc(B.annotate_cdc(envelope, now, cdc.AFTER_FIELDS["transactions"]))
    assert sorted(map(str, once[1].collect())) == sorted(map(str, twice[1].collect()))
    for deletes in (False, True):
        want = sorted(map(str, cdc.cdc_changes(twice[0], "transactions", deletes).collect()))
        assert sorted(map(str, cdc.cdc_changes(once[0], "transactions", deletes).collect())) == want
        whole = cdc.silver_transactions(twice[0], deletes)
        columns = ["transaction_id", "amount", "dt"]
        few = B.split_cdc(B.annotate_cdc(envelope, now, cdc.image_fields("transactions", columns)))[0]
        assert sorted(map(str, cdc.silver_transactions(few, deletes, columns).collect())) == sorted(map(str, whole.select(*columns).collect()))
        assert whole.count() > 3
