from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions.casts import to_integer, to_money
from tidemark.functions.timeparse import (
    normalize_ts_text, parse_iso_timestamp, timestamp_from_text, utc_date, utc_wall_clock)


def _parse(spark, fn, texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    rows = df.select("raw", utc_wall_clock(fn(F.col("raw"))).alias("p")).collect()
    return {r.raw: r.p for r in rows}


def test_ladder_accepts_iso_and_epoch_millis(any_tz):
    millis = "1779442245000"  # 2026-05-22T09:30:45Z
    got = _parse(any_tz, timestamp_from_text, [
        "2026-05-22T09:30:45Z", "2026-05-22T09:30:45.123Z", "2026-05-22T09:30:45+00:00",
        "2026-05-22T09:30:45.123+00:00", millis])
    base = datetime(2026, 5, 22, 9, 30, 45)
    assert got["2026-05-22T09:30:45Z"] == base
    assert got["2026-05-22T09:30:45+00:00"] == base
    assert got["2026-05-22T09:30:45.123Z"] == base.replace(microsecond=123000)
    assert got["2026-05-22T09:30:45.123+00:00"] == base.replace(microsecond=123000)
    assert got[millis] == base


def test_micros_and_offsets_are_exact(any_tz):
    got = _parse(any_tz, parse_iso_timestamp, [
        "2026-05-24T14:19:26.000400Z", "2026-05-22T09:30:45.123456+03:00", "2026-05-22T09:30:45.123456Z"])
    assert got["2026-05-24T14:19:26.000400Z"] == datetime(2026, 5, 24, 14, 19, 26, 400)
    assert got["2026-05-22T09:30:45.123456+03:00"] == datetime(2026, 5, 22, 6, 30, 45, 123456)
    assert got["2026-05-22T09:30:45.123456Z"] == datetime(2026, 5, 22, 9, 30, 45, 123456)


def test_naive_text_is_utc_and_garbage_is_null(any_tz):
    got = _parse(any_tz, parse_iso_timestamp, [
        "2026-05-22T09:30:45", "2026-05-22T09:30:45.250", "2026-05-22 09:30:45", "not-a-timestamp", None])
    assert got["2026-05-22T09:30:45"] == datetime(2026, 5, 22, 9, 30, 45)
    assert got["2026-05-22T09:30:45.250"] == datetime(2026, 5, 22, 9, 30, 45, 250000)
    assert got["2026-05-22 09:30:45"] == datetime(2026, 5, 22, 9, 30, 45)
    assert got["not-a-timestamp"] is None
    assert got[None] is None


def test_utc_date_does_not_follow_session_zone(any_tz):
    df = any_tz.createDataFrame([("2026-05-22T01:00:00Z",)], "raw string")
    row = df.select(utc_date(parse_iso_timestamp(F.col("raw"))).alias("d")).first()
    assert str(row.d) == "2026-05-22"


def test_normal_form_converts_to_utc_millis(any_tz):
    df = any_tz.createDataFrame([("2026-05-22T15:30:00+03:00",), ("2026-05-22T15:30:00.123999Z",)], "raw string")
    out = [r.t for r in df.select(normalize_ts_text(parse_iso_timestamp(F.col("raw"))).alias("t")).collect()]
    assert out == ["2026-05-22T12:30:00.000Z", "2026-05-22T15:30:00.123Z"]


def test_ansi_safe_casts(utc):
    df = utc.createDataFrame(
        [("12.5", "1.005"), ("abc", "99999999999999999999.99"), (" -7 ", "-3.10"), (None, None)], "i string, m string")
    rows = df.select(to_integer(F.col("i")).alias("i"), to_money(F.col("m")).alias("m")).collect()
    assert [r.i for r in rows] == [12, None, -7, None]
    assert [r.m for r in rows] == [Decimal("1.01"), None, Decimal("-3.10"), None]
