"""Published tables, incremental silver and compacted bronze against full rebuilds."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import bronze_cdc, bronze_clicks, cdc_row, click_row
from tidemark.operators import cdc, sessions
from tidemark.plans import compaction, incremental, refresh
from tidemark.streaming import ingest

T0 = datetime(2026, 3, 3, 10)


@pytest.fixture
def lh(utc):
    house = ingest.fresh_lakehouse(utc, "inc")
    house.init()
    return house


def load(lh, bronze, df, batch, ingest_id="w1"):
    ingest.overwrite_batch(lh, bronze, df.drop("ingest_id", "batch_id"), batch, ingest_id)


def same(a, b):
    columns = sorted(a.columns)
    left, right = (sorted(map(repr, df.select(*columns).collect())) for df in (a, b))
    assert left == right


def changes(seed, n=160, keys=14):
    """Versions of a few transactions: late ones, days that move, times that are missing, deletes."""
    rng = random.Random(seed)
    rows = []
    for offset in range(n):
        key = f"k{rng.randrange(keys)}"
        ts = rng.choice([None, T0 + timedelta(minutes=rng.randrange(60))])
        op = rng.choice("ccuuud")
        after = None if op == "d" else {
            "id": key, "user_id": "u1", "account_id": "a1", "type": "payment", "direction": "debit", "amount": f"{offset}.25",
            "currency": "EUR", "occurred_at": rng.choice([None, f"2026-03-0{rng.randrange(1, 6)}T08:00:00Z"])}
        rows.append(cdc_row(after, op=op, event_ts=ts, partition_id=offset % 3, offset=offset, key=key, dt=date(2026, 3, 9)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("apply_deletes", [False, True])
def test_current_rows_equal_a_full_build_after_every_batch(utc, lh, apply_deletes):
    rows = changes(4)
    for batch, at in enumerate(range(0, len(rows), 40)):
        load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, rows[at:at + 40]), batch)
        incremental.merge_current(lh, "transactions", apply_deletes)
        same(lh.table("silver.transactions"), cdc.silver_transactions(lh.table("bronze.pg_cdc_raw"), apply_deletes))
    assert incremental.merge_current(lh, "transactions", apply_deletes) == set()  # nothing new


def test_small_tables_equal_a_full_build(utc, lh):
    rows = [cdc_row({"id": f"u{i % 5}", "full_name": f"n{i}", "email": "e"}, op="u", table="users", event_ts=T0 + timedelta(minutes=(7 * i) % 31),
                    offset=i) for i in range(40)]
    for batch in range(3):
        load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, rows[batch::3]), batch)
        incremental.merge_current(lh, "users")
    same(lh.table("silver.users"), cdc.silver_users(lh.table("bronze.pg_cdc_raw")))


def clicks(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = T0 + timedelta(minutes=rng.choice([1, 5, 29, 30, 31]) * rng.randrange(120), seconds=rng.randrange(2))
        rows.append(click_row(f"e-{i}", ts, session_id=rng.choice(["s1", "s1", "s1", "s2", "s3-001", None]), offset=i, partition_id=i % 2))
    rng.shuffle(rows)
    return [*rows, rows[0]]


def test_sessions_equal_a_full_build_with_late_events(utc, lh):
    rows = clicks(8)
    for batch, at in enumerate(range(0, len(rows), 38)):
        load(lh, "bronze.clickstream_raw", bronze_clicks(utc, rows[at:at + 38]), batch)
        incremental.merge_events(lh)
        same(lh.table("silver.clickstream_events"), sessions.sessionize(lh.table("bronze.clickstream_raw")))


def test_events_in_order_touch_no_stored_event_of_another_day(utc, lh):
    first = [click_row(f"e-{i}", T0 + timedelta(hours=i), offset=i) for i in range(3)]
    load(lh, "bronze.clickstream_raw", bronze_clicks(utc, first), 0)
    assert incremental.merge_events(lh) == {T0.date()}
    load(lh, "bronze.clickstream_raw", bronze_clicks(utc, [click_row("e-9", T0 + timedelta(days=1), offset=9)]), 1)
    assert incremental.merge_events(lh) == {T0.date() + timedelta(days=1)}
    # Between two old sessions: those behind it get new numbers, on both days.
    load(lh, "bronze.clickstream_raw", bronze_clicks(utc, [click_row("e-5", T0 + timedelta(minutes=95), offset=5)]), 2)
    assert incremental.merge_events(lh) == {T0.date()}  # it joins the session of 12:00, no number changes
    load(lh, "bronze.clickstream_raw", bronze_clicks(utc, [click_row("e-6", T0 - timedelta(hours=1), offset=6)]), 3)
    assert incremental.merge_events(lh) == {T0.date(), T0.date() + timedelta(days=1)}
    same(lh.table("silver.clickstream_events"), sessions.sessionize(lh.table("bronze.clickstream_raw")))


def test_only_new_batches_are_read(utc, lh):
    rows = changes(5, 30)
    for batch in range(3):
        load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, rows[batch::3]), batch)
    incremental.merge_current(lh, "transactions")
    load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, changes(6, 5)), 3)
    new = incremental.new_batches(lh, "silver.transactions")
    assert new == [("w1", 3)]
    files = lh.table("bronze.pg_cdc_raw").filter(incremental.in_batches(new)).inputFiles()
    assert files and all("batch_id=3" in f for f in files)


def test_a_run_that_fails_before_or_after_its_commit_point(utc, lh, monkeypatch):
    rows = changes(7, 60)
    load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, rows[:30]), 0)
    incremental.merge_current(lh, "transactions")
    before = sorted(map(repr, lh.table("silver.transactions").collect()))
    load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, rows[30:]), 1)

    def fail(*_args, **_kw):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(type(lh), "write_version", fail)  # state is written before the note
        incremental.merge_current(lh, "transactions")
    assert sorted(map(repr, lh.table("silver.transactions").collect())) == before
    assert len(incremental.new_batches(lh, "silver.transactions")) == 1
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(type(lh), "switch", fail)  # after the note, between rows and state
        incremental.merge_current(lh, "transactions")
    incremental.merge_current(lh, "transactions")
    assert incremental.new_batches(lh, "silver.transactions") == []
    same(lh.table("silver.transactions"), cdc.silver_transactions(lh.table("bronze.pg_cdc_raw")))


def test_incremental_refresh_equals_a_full_one(utc, lh):
    rows, events = changes(9, 60), clicks(10, 60)
    for batch in range(3):
        load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, rows[batch::3]), batch)
        load(lh, "bronze.clickstream_raw", bronze_clicks(utc, events[batch::3]), batch)
        incremental.refresh_incremental(lh, as_of=F.lit(T0))
    tables = [t for t, _ in refresh.builds()]
    got = {t: sorted(map(repr, lh.table(t).select(*sorted(lh.table(t).columns)).collect())) for t in tables}
    refresh.refresh_all(lh, as_of=F.lit(T0))
    for t in tables:
        assert got[t] == sorted(map(repr, lh.table(t).select(*sorted(lh.table(t).columns)).collect())), t


# -- published tables ---------------------------------------------------

def users(utc, names):
    rows = [(n, n, "e", None, None) for n in names]
    return utc.createDataFrame(rows, "user_id string, full_name string, email string, created_at timestamp, event_ts timestamp")


def test_a_failed_write_leaves_the_old_rows(utc, lh):
    lh.publish("silver.users", users(utc, "ab"))
    broken = users(utc, "cdefgh").repartition(6).withColumn(
        "email", F.when(F.col("user_id") == "h", F.raise_error(F.lit("broken"))).otherwise(F.col("email")))
    with pytest.raises(Exception, match="broken"):
        lh.overwrite("silver.users", broken, mode="full")
    assert {r.user_id for r in lh.table("silver.users").collect()} == {"a", "b"}


def test_readers_never_see_an_empty_table(utc, lh):
    lh.publish("silver.users", users(utc, "ab"))
    reader = utc.table(lh.name("silver.users"))
    reader.count()
    lh.publish("silver.users", lh.table("silver.users").union(users(utc, "c")))  # reads the table that it replaces
    assert reader.count() == 2  # planned before the switch: the old rows
    assert {r.user_id for r in utc.table(lh.name("silver.users")).collect()} == {"a", "b", "c"}
    lh.publish("silver.users", users(utc, ""))
    assert lh.table("silver.users").isEmpty()


def test_publishing_days_replaces_all_of_them(utc, lh):
    events = bronze_clicks(utc, [click_row("e-1", T0), click_row("e-2", T0 + timedelta(days=2))])
    lh.publish("silver.clickstream_events", sessions.sessionize(events))
    lh.publish("silver.clickstream_events", sessions.sessionize(events.filter(F.col("event_id") == "e-2")))
    assert [r.dt for r in lh.table("silver.clickstream_events").collect()] == [T0.date() + timedelta(days=2)]


# -- compaction ---------------------------------------------------------

def partitions(lh, bronze):
    return [r.partition for r in lh.spark.sql(f"SHOW PARTITIONS {lh.name(bronze)}").collect()]


def test_batches_become_days(utc, lh):
    for batch in range(24):
        rows = [click_row(f"e-{batch}", T0 + timedelta(days=batch % 3), offset=batch), click_row(f"x-{batch}", T0, offset=batch)]
        load(lh, "bronze.clickstream_raw", bronze_clicks(utc, rows), batch)
    columns = ["event_id", "offset_value", "event_ts", "dt"]
    before = lh.table("bronze.clickstream_raw").select(*columns)
    kept = sorted(map(repr, before.collect()))
    assert compaction.compact(lh, "bronze.clickstream_raw", "w1") == 22
    assert len(partitions(lh, "bronze.clickstream_raw")) <= 3 + 2
    assert sorted(map(repr, lh.table("bronze.clickstream_raw").select(*columns).collect())) == kept
    assert sorted(map(repr, utc.table(lh.name("bronze.clickstream_raw")).select(*columns).collect())) == kept  # by name
    with pytest.raises(ingest.CompactedBatch):
        load(lh, "bronze.clickstream_raw", bronze_clicks(utc, [click_row("e-1", T0)]), 4)
    load(lh, "bronze.clickstream_raw", bronze_clicks(utc, [click_row("e-99", T0)]), 24)
    assert compaction.compact(lh, "bronze.clickstream_raw", "w1") == 23  # the generation is compacted again
    assert lh.table("bronze.clickstream_raw").count() == 49


def test_compaction_that_fails_shows_every_row_once(utc, lh, monkeypatch):
    for batch in range(4):
        load(lh, "bronze.clickstream_raw", bronze_clicks(utc, [click_row(f"e-{batch}", T0, offset=batch)]), batch)

    def fail(*_args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(compaction, "_consumers", fail)  # before the mark
        compaction.compact(lh, "bronze.clickstream_raw", "w1", 2)
    assert lh.table("bronze.clickstream_raw").count() == 4
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(compaction, "clean", fail)  # after the mark
        compaction.compact(lh, "bronze.clickstream_raw", "w1", 2)
    assert lh.table("bronze.clickstream_raw").count() == 4
    compaction.compact(lh, "bronze.clickstream_raw", "w1", 2)
    assert utc.table(lh.name("bronze.clickstream_raw")).count() == 4


def test_compaction_waits_for_silver_and_is_not_read_again(utc, lh):
    rows = clicks(11, 60)
    for batch in range(3):
        load(lh, "bronze.clickstream_raw", bronze_clicks(utc, rows[batch * 10:batch * 10 + 10]), batch)
    incremental.merge_events(lh)
    for batch in range(3, 6):
        load(lh, "bronze.clickstream_raw", bronze_clicks(utc, rows[batch * 10:batch * 10 + 10]), batch)
    assert compaction.compact(lh, "bronze.clickstream_raw", "w1") == 2  # silver has not seen batch 3
    assert incremental.new_batches(lh, "silver.clickstream_events") == [("w1", b) for b in (3, 4, 5)]
    incremental.merge_events(lh)
    same(lh.table("silver.clickstream_events"), sessions.sessionize(lh.table("bronze.clickstream_raw")))


# -- a new catalog on the same root ---------------------------------------

def forget_catalog(lh):
    """What a new session with an in-memory catalog sees of the root: no table at all."""
    for ns in ("bronze", "silver", "gold", "state"):
        if lh.spark.catalog.databaseExists(f"{lh.prefix}{ns}"):
            for t in lh.spark.catalog.listTables(f"{lh.prefix}{ns}"):
                lh.spark.sql(f"DROP TABLE {lh.prefix}{ns}.{t.name}")


def test_a_new_catalog_finds_everything_again(utc, lh):
    rows = changes(12, 40)
    for batch in range(4):
        load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, rows[batch::4]), batch)
    incremental.merge_current(lh, "transactions")
    compaction.compact(lh, "bronze.pg_cdc_raw", "w1")
    bronze, silver = (sorted(map(repr, lh.table(t).drop("batch_id").collect())) for t in ("bronze.pg_cdc_raw", "silver.transactions"))
    forget_catalog(lh)
    lh.init()
    assert sorted(map(repr, lh.table("bronze.pg_cdc_raw").drop("batch_id").collect())) == bronze
    assert sorted(map(repr, lh.table("silver.transactions").drop("batch_id").collect())) == silver
    with pytest.raises(ingest.CompactedBatch):
        load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, rows[:2]), 1)
    assert incremental.merge_current(lh, "transactions") == set()


def test_command_line_jobs(utc, tmp_path, capsys):
    from tidemark import cli
    from tidemark.plans.catalog import Lakehouse
    lh = Lakehouse(utc, root=str(tmp_path / "lh"), prefix="cli_")
    lh.init()
    for batch in range(2):
        load(lh, "bronze.clickstream_raw", bronze_clicks(utc, clicks(13, 20)[batch::2]), batch)
        load(lh, "bronze.pg_cdc_raw", bronze_cdc(utc, changes(14, 20)[batch::2]), batch)
    for job in (["refresh", "--incremental"], ["compact"], ["statistics"], ["refresh", "--incremental"], ["check"]):
        assert cli.main(["--root", lh.root, "--prefix", "cli_", *job]) == 0
    said = capsys.readouterr().out
    assert "silver.transactions: 0 days changed" in said and "bronze.pg_cdc_raw w1: up to batch 0" in said
