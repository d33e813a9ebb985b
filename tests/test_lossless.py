"""Bronze keeps every load, silver keeps one row per key, and money that outgrows its type is NULL."""

import os
import shutil
import tempfile
from datetime import date, datetime
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import ACCOUNT_SCHEMA, TX_SCHEMA, bronze_cdc, bronze_clicks, cdc_row, click_row, frame
from tidemark.operators import ledger, marts, sessions
from tidemark.plans import refresh
from tidemark.sources import testdata
from tidemark.streaming import ingest


def _events(n):
    folder = tempfile.mkdtemp(prefix="tm-lossless-")
    pq.write_table(pq.read_table(f"{SF_SMALL}/events.parquet").slice(0, n), f"{folder}/events.parquet")
    return folder


def test_recreated_checkpoint_adds_to_bronze(utc):
    lh = ingest.fresh_lakehouse(utc, "t-recreated")
    checkpoint = f"{lh.root}/_cp"
    total = 0
    for n in (1000, 500):
        local = checkpoint.removeprefix("file:")
        if os.path.exists(local):
            shutil.move(local, f"{local}-old")
        query = ingest.start_bronze_ingest(ingest.click_envelope_stream(utc, _events(n)), "clicks", lh, checkpoint)
        assert ingest.run_to_completion(query)
        total += n
        assert lh.table("bronze.clickstream_raw").count() == total


def test_loads_are_named_and_kept(utc):
    lh = ingest.fresh_lakehouse(utc, "t-loads")
    cdc, clicks = testdata.cdc_envelopes(utc, SF_SMALL), testdata.click_envelopes(utc, SF_SMALL)
    with pytest.raises(TypeError):
        refresh.load_bronze_batch(lh, cdc, clicks)
    for load in ("a", "b", "b"):
        refresh.load_bronze_batch(lh, cdc, clicks, load_id=load)
    counts = {r[0]: r[1] for r in lh.table("bronze.clickstream_raw").groupBy("ingest_id").count().collect()}
    assert counts == {"a": 1000, "b": 1000}


def test_moved_business_day_leaves_one_row(utc):
    lh = ingest.fresh_lakehouse(utc, "t-moved")
    lh.init()
    after = {"id": "t9", "user_id": "u9", "account_id": "a9", "type": "transfer", "direction": "credit", "amount": "5.00", "currency": "EUR"}
    account = {"id": "a9", "user_id": "u9", "currency": "EUR", "opening_balance": "1.00"}
    rows = [
        cdc_row(dict(after, occurred_at="2026-03-01T08:00:00Z"), event_ts=datetime(2026, 3, 1, 8), offset=1),
        cdc_row(account, table="accounts", event_ts=datetime(2026, 3, 1, 7), offset=1),
    ]
    lh.append("bronze.pg_cdc_raw", bronze_cdc(utc, rows).withColumn("ingest_id", F.lit("x")))
    refresh.refresh_all(lh)
    assert [r.dt for r in lh.table("silver.transactions").collect()] == [date(2026, 3, 1)]
    moved = [cdc_row(dict(after, occurred_at="2026-03-04T08:00:00Z"), op="u", event_ts=datetime(2026, 3, 4, 8), offset=2)]
    lh.append("bronze.pg_cdc_raw", bronze_cdc(utc, moved).withColumn("ingest_id", F.lit("y")))
    refresh.refresh_all(lh)
    assert [r.dt for r in lh.table("silver.transactions").collect()] == [date(2026, 3, 4)]
    balance = lh.table("gold.current_balances").first()
    assert (balance.balance, balance.transactions_count) == (Decimal("6.00"), 1)


def test_money_beyond_18_digits_is_null_in_that_row_only(utc):
    most = Decimal("9999999999999999.99")
    day = date(2026, 3, 1)
    tx = [
        {"transaction_id": f"t{i}", "user_id": u, "account_id": f"acc-{u}", "direction": d, "amount": a, "currency": "EUR", "occurred_at": datetime(2026, 3, 1), "dt": day}
        for i, (u, d, a) in enumerate([("big", "credit", most), ("big", "credit", most), ("small", "credit", Decimal("2.00")), ("small", "debit", Decimal("0.50"))])
    ]
    accounts = [{"user_id": u, "account_id": f"acc-{u}", "currency": "EUR", "opening_balance": Decimal("1.00")} for u in ("big", "small")]
    tx, accounts = frame(utc, TX_SCHEMA, tx), frame(utc, ACCOUNT_SCHEMA, accounts)
    balances = {r.user_id: r.balance for r in marts.current_balances(accounts, tx).collect()}
    assert balances == {"big": None, "small": Decimal("2.50")}
    volume = {r.user_id: (r.credit_amount, r.debit_amount) for r in marts.transaction_volume_daily(tx).collect()}
    assert volume == {"big": (None, Decimal("0.00")), "small": (Decimal("2.00"), Decimal("0.50"))}
    assert ledger is not None


def test_record_ingested_twice_opens_one_session(utc):
    row = click_row("event-1", datetime(2026, 3, 1, 9), session_id="s")
    flags = [r.new_session_flag for r in sessions.session_flags(bronze_clicks(utc, [row, row])).collect()]
    assert sorted(flags) == [0, 1]


def test_unreadable_table_is_reported_beside_the_others(utc):
    lh = ingest.fresh_lakehouse(utc, "t-corrupt")
    lh.init()
    folder = lh.path("silver.users").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/part-0.parquet", "wb") as f:
        f.write(b"no parquet")
    status = {r.table.split("_", 1)[-1]: r.status for r in lh.check_tables().collect()}
    assert status["silver.users"].startswith("failed") and status["silver.accounts"] == "ok" and len(status) == 17
