import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import bronze_clicks, click_row
from tidemark.operators import sessions
from tidemark.operators.scans import (bucketed_running, bucketed_session_numbers, window_running,
                                      window_session_numbers)


def _ids(df):
    return {r.event_id: r.analytics_session_id for r in df.collect()}


def test_idle_gaps_split_interleaved_sessions(any_tz):
    """Two raw sessions whose events alternate: each one counts its own gaps only."""
    t0 = datetime(2025, 8, 30, 23, 10)
    minutes = {"left": [0, 29, 58, 90, 121, 122], "right": [15, 46, 76, 300]}
    rows = [click_row(f"{raw}-{m}", t0 + timedelta(minutes=m), session_id=raw) for raw, own in minutes.items() for m in own]
    got = _ids(sessions.sessionize(bronze_clicks(any_tz, rows[::-1])))
    assert [got[f"left-{m}"][-3:] for m in minutes["left"]] == ["001", "001", "001", "002", "003", "003"]
    assert [got[f"right-{m}"] for m in minutes["right"]] == ["right-001", "right-002", "right-002", "right-003"]


@pytest.mark.parametrize("gap,expected", [
    (timedelta(seconds=1800), "session-1-001"),
    (timedelta(seconds=1800, microseconds=900000), "session-1-001"),  # whole seconds (S4)
    (timedelta(seconds=1801), "session-1-002"),
])
def test_gap_boundary(utc, gap, expected):
    t0 = datetime(2026, 5, 22, 12, 0, 0)
    rows = [click_row("event-1", t0), click_row("event-2", t0 + gap)]
    assert _ids(sessions.sessionize(bronze_clicks(utc, rows)))["event-2"] == expected


def test_null_session_id_has_no_analytics_id(utc):
    t0 = datetime(2026, 5, 22, 12, 0, 0)
    rows = [click_row("event-1", t0, session_id=None), click_row("event-2", t0)]
    got = _ids(sessions.sessionize(bronze_clicks(utc, rows)))
    assert got == {"event-1": None, "event-2": "session-1-001"}
    assert sessions.sessions(sessions.sessionize(bronze_clicks(utc, rows))).count() == 1


def test_ordinal_past_999_does_not_collide(utc):
    t0 = datetime(2026, 1, 1)
    rows = [click_row(f"event-{i}", t0 + timedelta(hours=i)) for i in range(1, 1003)]
    got = _ids(sessions.sessionize(bronze_clicks(utc, rows)))
    assert got["event-999"] == "session-1-999"
    assert got["event-1000"] == "session-1-1000"
    assert got["event-1001"] == "session-1-1001"
    assert len(set(got.values())) == 1002


def test_equal_timestamps_order_by_offset(utc):
    t0 = datetime(2026, 5, 22, 12, 0, 0)
    rows = [click_row("event-2", t0, offset=2), click_row("event-1", t0 - timedelta(hours=1), offset=1),
            click_row("event-3", t0, offset=3)]
    got = _ids(sessions.sessionize(bronze_clicks(utc, rows)))
    assert got == {"event-1": "session-1-001", "event-2": "session-1-002", "event-3": "session-1-002"}


def test_null_event_time_falls_back_to_ingest_time(utc):
    rows = [click_row("event-1", None)]
    out = sessions.sessionize(bronze_clicks(utc, rows)).first()
    assert out.event_ts == datetime(2026, 5, 22, 23, 0, 0)


def test_sessions_aggregate(utc):
    t0 = datetime(2026, 5, 22, 23, 50, 0)
    rows = [click_row("event-1", t0, dwell_ms=None), click_row("event-2", t0 + timedelta(minutes=20),
                                                               event_type="page_leave", dwell_ms=1500)]
    s = sessions.sessions(sessions.sessionize(bronze_clicks(utc, rows))).collect()
    assert len(s) == 1
    r = s[0]
    assert (r.session_id, r.raw_session_id, r.user_id, r.events_count, r.total_dwell_ms) == (
        "session-1-001", "session-1", "user-1", 2, 1500)
    assert r.started_at == t0 and r.ended_at == t0 + timedelta(minutes=20)
    assert str(r.dt) == "2026-05-22"


def _random_events(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    t0 = datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        key = rnd.choice(["hot"] * 6 + ["a", "b", "c"])  # one key holds most rows
        ts = None if rnd.random() < 0.01 else t0 + timedelta(seconds=rnd.randint(0, 3 * 86400),
                                                               microseconds=rnd.randint(0, 999999))
        rows.append((key, ts, rnd.randint(0, 3), i, rnd.choice([None, 1.5, -2.0, 10.0])))
    return spark.createDataFrame(rows, "k string, ts timestamp, p int, o bigint, v double")


@pytest.mark.parametrize("bucket", [60, 900, 86400])
def test_bucketed_sessions_equal_single_window(utc, bucket):
    df = _random_events(utc)
    order = [F.col("ts").asc(), F.col("p").asc(), F.col("o").asc()]
    secs = F.unix_timestamp("ts")
    a = bucketed_session_numbers(df, "k", order, secs, 1800, "n", bucket_seconds=bucket)
    b = window_session_numbers(df, "k", order, secs, 1800, "n")
    assert sorted(a.select("o", "n").collect()) == sorted(b.select("o", "n").collect())


@pytest.mark.parametrize("how", ["sum", "max"])
def test_bucketed_running_equal_single_window(utc, how):
    df = _random_events(utc)
    order = [F.col("ts").asc(), F.col("p").asc(), F.col("o").asc()]
    a = bucketed_running(df, ["k"], order, F.unix_timestamp("ts"), F.col("v"), "r", how, bucket_seconds=3600)
    b = window_running(df, ["k"], order, F.col("v"), "r", how)
    assert sorted(a.select("o", "r").collect()) == sorted(b.select("o", "r").collect())


def test_shuffled_input_gives_same_sessions(utc):
    from tidemark.plans.layers import Layers
    from conftest import SF_SMALL
    clicks = Layers(utc, SF_SMALL).bronze_clicks
    base = sessions.sessionize(clicks).select("event_id", "analytics_session_id")
    shuffled = sessions.sessionize(clicks.repartition(7, F.rand(3))).select("event_id", "analytics_session_id")
    assert base.exceptAll(shuffled).count() == 0 and shuffled.exceptAll(base).count() == 0


def test_hot_key_is_spread_over_tasks(utc):
    """One key holds 2/3 of the rows. Planned as at scale (no broadcast, no
    partition coalescing): the window form puts the whole key in one
    partition, the bucketed form spreads it over its time buckets."""
    hot = [("hot", T0_HOT + timedelta(minutes=7 * i), 0, i) for i in range(6000)]
    cold = [(f"k{j}", T0_HOT + timedelta(minutes=50 * i), 1, 10_000 + 100 * j + i)
            for j in range(30) for i in range(100)]
    df = utc.createDataFrame(hot + cold, "k string, ts timestamp, p int, o bigint")
    order = [F.col("ts").asc(), F.col("p").asc(), F.col("o").asc()]
    secs = F.unix_timestamp("ts")
    saved = {k: utc.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                          "spark.sql.shuffle.partitions")}
    utc.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    utc.conf.set("spark.sql.adaptive.enabled", "false")
    utc.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        def max_share(out):
            # Consume n, or Catalyst prunes the scan away before the count.
            sizes = [r.c for r in out.groupBy(F.spark_partition_id().alias("pid"))
                     .agg(F.count("n").alias("c")).collect()]
            return max(sizes) / sum(sizes)
        window = window_session_numbers(df, "k", order, secs, 1800, "n")
        bucketed = bucketed_session_numbers(df, "k", order, secs, 1800, "n")
        assert max_share(window) >= 0.66
        assert max_share(bucketed) < 0.25
        assert sorted(window.select("o", "n").collect()) == sorted(bucketed.select("o", "n").collect())
    finally:
        for k, v in saved.items():
            utc.conf.set(k, v)


T0_HOT = datetime(2026, 1, 1)
