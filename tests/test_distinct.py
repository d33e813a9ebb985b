"""Mergeable distinct counts and statistics by day."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import EVENT_SCHEMA, frame
from tidemark.operators import distinct
from tidemark.plans import statistics
from tidemark.session import stored
from tidemark.streaming import ingest

DAY = date(2025, 10, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = [{"dt": DAY + timedelta(days=rng.choice([0, 1, 2, 3, 9, 20])), "user_id": rng.choice([None, *(f"u{n}" for n in range(90))]),
             "page": rng.choice("ab"), "event_id": str(i), "event_ts": datetime(2025, 10, 1, 5, rng.randrange(60)),
             "dwell_ms": rng.choice([None, *range(-5, 30)])} for i in range(700)]
    return stored(frame(spark, EVENT_SCHEMA, rows), "distinct_events")


def test_merged_bitmaps_equal_a_count_of_all_rows(spark, events):
    early, late = events.filter(F.col("dt") < "2025-10-03"), events.filter(F.col("dt") >= "2025-10-03")
    known = stored(distinct.new_codes(early.select("user_id")), "codes")
    more = stored(distinct.new_codes(late.select("user_id"), known), "codes")
    codes = known.unionByName(more)
    assert codes.select("code").distinct().count() == codes.count() == codes.select("value").distinct().count()
    # The early days are not read again: their partial results are merged with those of the late ones.
    partial = stored(distinct.bitmaps(early, ["dt", "page"], "user_id", codes), "partial").unionByName(
        distinct.bitmaps(late, ["dt", "page"], "user_id", codes))
    for keys in (["dt", "page"], ["page"], ["dt"]):
        got = {tuple(r)[:-1]: r.users for r in distinct.merged_count(partial, keys, "users").collect()}
        assert got == {tuple(r)[:-1]: r.users for r in events.groupBy(*keys).agg(F.count_distinct("user_id").alias("users")).collect()}


def test_rolling_windows(spark, events):
    codes = stored(distinct.new_codes(events.select("user_id")), "codes")
    got = {r.dt: r.users for r in distinct.rolling_users(events, codes, 3).collect()}
    rows = events.select("dt", "user_id").collect()
    assert got == {day: len({r.user_id for r in rows if timedelta(0) <= day - r.dt < timedelta(days=3)} - {None}) for day in {r.dt for r in rows}}


def test_sketches_are_close_and_mergeable(spark):
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), (F.col("id") % 23_456).cast("string").alias("user"))
    partial = distinct.sketches(rows, ["day"], "user")
    found = distinct.merged_estimate(partial, [], "users").first().users
    assert abs(found - 23_456) < 4 * 1.04 / 2 ** (distinct.LG_K / 2) * 23_456
    assert distinct.sketches(rows.limit(0), ["day"], "user").count() == 0


def test_a_new_day_alone_is_read(utc, events):
    lh = ingest.fresh_lakehouse(utc, "stats")
    lh.init(["silver.clickstream_events", statistics.STATE])
    table = "silver.clickstream_events"
    lh.publish(table, events.filter(F.col("dt") < "2025-10-09"))
    assert len(statistics.update_statistics(lh, table)) == 4
    lh.publish(table, events)
    assert statistics.update_statistics(lh, table) == {DAY + timedelta(days=9), DAY + timedelta(days=20)}
    assert statistics.update_statistics(lh, table) == set()
    assert statistics.update_statistics(lh, table, {DAY}) == {DAY}
    got = {r["column"]: r for r in statistics.column_statistics(lh, table).collect()}
    rows = events.collect()
    for name in ("user_id", "page", "dwell_ms", "event_ts"):
        values = [r[name] for r in rows if r[name] is not None]
        assert (got[name].rows, got[name].nulls) == (len(rows), len(rows) - len(values))
        assert abs(got[name].distinct - len(set(values))) <= 1
    assert (float(got["dwell_ms"].low), float(got["dwell_ms"].high)) == (-5, 29)
    assert (got["page"].low, got["page"].high) == ("a", "b")
    assert got["event_ts"].low == min(r.event_ts for r in rows).strftime("%Y-%m-%d %H:%M:%S.%f")
    assert got["x"].nulls == len(rows) and got["x"].low is None


def test_statistics_of_a_table_without_days(utc):
    lh = ingest.fresh_lakehouse(utc, "stats-users")
    lh.init(["silver.users"])
    lh.publish("silver.users", utc.createDataFrame([("a", None), ("b", "n")], "user_id string, full_name string").select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in (("email", "string"), ("created_at", "timestamp"), ("event_ts", "timestamp"))]))
    assert statistics.update_statistics(lh, "silver.users") == {None}
    got = {r["column"]: (r.rows, r.nulls, r.distinct) for r in statistics.column_statistics(lh, "silver.users").collect()}
    assert got["user_id"] == (2, 0, 2) and got["full_name"] == (2, 1, 1) and got["email"] == (2, 2, 0)
