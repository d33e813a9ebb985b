"""Property tests: skew-safe operators equal their direct window forms."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.cdc import latest_per_key
from tidemark.operators.scans import (bucketed_running, bucketed_session_numbers, window_running,
                                      window_session_numbers)

T0 = datetime(2026, 1, 1)
rows_strategy = st.lists(
    st.tuples(
        st.sampled_from(["k1", "k2", "k3"]),
        st.one_of(st.none(), st.integers(min_value=0, max_value=20_000)),  # seconds after T0
        st.integers(min_value=0, max_value=3),                              # partition
        st.integers(min_value=0, max_value=50),                             # value
    ),
    min_size=1, max_size=60,
)
SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))


def _frame(spark, rows):
    data = [(k, None if s is None else T0 + timedelta(seconds=s, microseconds=i), p, i, float(v))
            for i, (k, s, p, v) in enumerate(rows)]
    return spark.createDataFrame(data, "k string, ts timestamp, p int, o bigint, v double")


@SETTINGS
@given(rows=rows_strategy, gap=st.sampled_from([1, 30, 600, 1800]))
def test_sessions_property(spark, rows, gap):
    df = _frame(spark, rows)
    order = [F.col("ts").asc(), F.col("p").asc(), F.col("o").asc()]
    secs = F.unix_timestamp("ts")
    a = bucketed_session_numbers(df, "k", order, secs, gap, "n").select("o", "n").collect()
    b = window_session_numbers(df, "k", order, secs, gap, "n").select("o", "n").collect()
    assert sorted(a) == sorted(b)


@SETTINGS
@given(rows=rows_strategy, how=st.sampled_from(["sum", "max"]), width=st.sampled_from([7, 600, 86_400]))
def test_running_property(spark, rows, how, width):
    df = _frame(spark, rows)
    order = [F.col("ts").asc(), F.col("p").asc(), F.col("o").asc()]
    a = bucketed_running(df, ["k"], order, F.unix_timestamp("ts"), F.col("v"), "r", how, width)
    b = window_running(df, ["k"], order, F.col("v"), "r", how)
    assert sorted(a.select("o", "r").collect()) == sorted(b.select("o", "r").collect())


@SETTINGS
@given(rows=rows_strategy)
def test_latest_per_key_property(spark, rows):
    df = _frame(spark, rows).select("k", F.col("ts").alias("event_ts"), F.col("p").alias("partition_id"),
                                    F.col("o").alias("offset_value"), "v")
    got = {r.k: r.offset_value for r in latest_per_key(df, "k").collect()}
    w = Window.partitionBy("k").orderBy(F.col("event_ts").desc_nulls_last(), F.col("partition_id").desc(),
                                        F.col("offset_value").desc())
    ref = {r.k: r.offset_value for r in df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect()}
    assert got == ref
