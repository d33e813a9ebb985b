"""Skew-safe ordered scans: running totals and idle-gap session numbers.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a key in
one task; a key holding a third of the data would be a third of the job on
one core. The scans here split a key by a time *bucket*:

1. a ``groupBy(key, bucket)`` summary (one row per bucket, map-side
   partial aggregation) is scanned per key -- a small window over buckets,
2. the rows are joined with the summary on ``(key, bucket)`` (AQE may
   broadcast the summary when its measured size is small, or split a hot
   bucket with its skew-join handling),
3. running aggregates that need the order inside a bucket add a window
   over ``(key, bucket)`` -- a bucket, not a whole key, per task.

Results equal the single-window scans exactly (tests compare both).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

# Sentinel bucket for rows whose ordering time is NULL: sorts first, as
# NULLs do in an ascending window order.
NULL_BUCKET = -(2 ** 62)


def time_bucket(seconds: Column, bucket_seconds: int) -> Column:
    return F.coalesce(F.floor(seconds / F.lit(bucket_seconds)).cast("bigint"), F.lit(NULL_BUCKET))


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], running: Column, label: str) -> DataFrame:
    """``df`` in ranges of (keys, order), written once: ``_part`` is a row's range, ``_at`` rises along
    the order within it, ``_prefix`` is the aggregate ``running`` over the rows of the same key and range so far.

    Ranges are cut by row counts, so that a key with most of the rows, even
    all at one instant, is spread over as many tasks as its size asks for."""
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    local = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stored(placed.withColumn("_prefix", running.over(local)), label)


def ranged_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, label: str) -> DataFrame:
    """``out`` = running maximum of ``value`` over the rows of the same key up to the current one.

    One row per key and range takes part in the scan over a key and in the join."""
    rows = ranged(df.withColumn("_v", value), keys, order, F.max("_v"), label)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*keys, "_part").agg(F.max("_v").alias("_most")).select(*keys, "_part", F.max("_most").over(before).alias("_before"))
    joined = rows.join(ranges, [*keys, "_part"])
    return joined.withColumn(out, F.greatest("_before", "_prefix")).drop("_part", "_at", "_v", "_prefix", "_before")


def bucketed_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], seconds: Column,
    value: Column, out: str, how: str = "sum", bucket_seconds: int = 86_400,
    initial: DataFrame | None = None,
) -> DataFrame:
    """``out`` = running ``sum`` or ``max`` of ``value`` over the rows of the
    same key up to the current one in ``order`` (ROWS UNBOUNDED PRECEDING ..
    CURRENT ROW), computed per time bucket and stitched by a small scan.

    ``seconds`` must be non-decreasing along ``order`` within a key (it is
    the leading ordering column in epoch seconds). ``initial`` (``keys`` +
    ``_init``) adds a starting value per key (``sum`` only); it is joined to
    the small bucket summary, never to the rows."""
    if how not in ("sum", "max"):
        raise ValueError(f"unsupported running aggregate {how!r}")
    agg = F.sum if how == "sum" else F.max
    keys = list(keys)
    local_w = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    base = df.withColumn("_bucket", time_bucket(seconds, bucket_seconds)).withColumn("_v", value)
    local = base.withColumn("_local", agg("_v").over(local_w))
    before_w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # The bucket totals come straight from the rows (a partial aggregate),
    # not from the windowed rows, so the window runs once.
    summary = (
        base.groupBy(*keys, "_bucket").agg(agg("_v").alias("_bucket_total"))
        .withColumn("_before", agg("_bucket_total").over(before_w))
        .select(*keys, "_bucket", "_before")
    )
    if initial is not None:
        if how != "sum":
            raise ValueError("initial values apply to running sums")
        summary = summary.join(initial.select(*keys, "_init"), keys, "left").select(
            *keys, "_bucket",
            F.when(F.col("_init").isNull(), F.col("_before"))
            .otherwise(F.col("_init") + F.coalesce(F.col("_before"), F.lit(0))).alias("_before"))
    # Left join: every row has its bucket's summary row, and the summary is
    # distinct on the join keys, so Catalyst can drop the join when no
    # caller reads the result column.
    joined = local.join(summary, [*keys, "_bucket"], "left")
    if how == "sum":
        total = F.when(F.col("_before").isNull(), F.col("_local")).otherwise(
            F.col("_before") + F.coalesce(F.col("_local"), F.lit(0)))
    else:
        total = F.greatest(F.col("_before"), F.col("_local"))
    return joined.withColumn(out, total).drop("_bucket", "_v", "_local", "_before")


def window_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                   value: Column, out: str, how: str = "sum") -> DataFrame:
    """Single-window reference of ``bucketed_running`` (tests, small data)."""
    agg = F.sum if how == "sum" else F.max
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, agg(value).over(w))


def bucketed_session_numbers(
    df: DataFrame, key: str, order: Sequence[Column | str], seconds: Column,
    gap_seconds: int, out: str, bucket_seconds: int | None = None,
    null_rows: Column | None = None,
) -> DataFrame:
    """Idle-gap session number per row (1, 2, ...) within ``key``.

    A row opens a new session when it is the first of its key, when the
    previous row's ``seconds`` is NULL, or when the gap to it is strictly
    greater than ``gap_seconds`` (whole seconds, S4). ``seconds`` must be
    non-decreasing along ``order`` within a key.

    With buckets no wider than ``gap_seconds + 1`` two rows of one bucket
    are never more than the gap apart, so only a bucket's first row can
    open a session. Hence the per-bucket summary is just ``min``/``max`` of
    ``seconds`` -- a partial (map-side) aggregate -- and a small per-key scan
    over buckets numbers them. The rows themselves are shuffled once, for the
    join with that summary; no window runs over the rows of a key. Rows with
    NULL ``seconds`` (each one opens a session, and they sort first) are
    numbered in a side branch. ``null_rows`` -- true exactly when
    ``seconds`` is NULL -- may be given on plain input columns so that the
    split reaches the file scan (row groups without NULLs are skipped).
    """
    width = max(1, min(bucket_seconds or gap_seconds, gap_seconds + 1))
    timed = df.withColumn("_s", seconds).withColumn(
        "_bucket", F.floor(F.col("_s") / F.lit(width)).cast("bigint"))
    is_null = null_rows if null_rows is not None else F.col("_s").isNull()
    known = timed.filter(~is_null)
    unknown = timed.filter(is_null)

    bucket_w = Window.partitionBy(key).orderBy("_bucket")
    prev_last = F.lag("_last").over(bucket_w)
    nulls_per_key = unknown.groupBy(key).agg(F.count(F.lit(1)).alias("_nulls"))
    summary = (
        known.groupBy(key, "_bucket").agg(F.min("_s").alias("_start"), F.max("_s").alias("_last"))
        .withColumn("_open", F.when(prev_last.isNull() | (F.col("_start") - prev_last > gap_seconds),
                                    F.lit(1)).otherwise(F.lit(0)))
        .withColumn("_run", F.sum("_open").over(
            bucket_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(nulls_per_key, key, "left")
        .select(key, "_bucket", (F.col("_run") + F.coalesce("_nulls", F.lit(0))).alias("_number"))
    )
    numbered = known.join(summary, [key, "_bucket"], "left").withColumn(out, F.col("_number").cast("bigint"))
    null_numbered = unknown.withColumn(
        out, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))
    return numbered.drop("_s", "_bucket", "_number").unionByName(null_numbered.drop("_s", "_bucket"))


def window_session_numbers(
    df: DataFrame, key: str, order: Sequence[Column | str], seconds: Column,
    gap_seconds: int, out: str,
) -> DataFrame:
    """Single-window reference of ``bucketed_session_numbers`` (tests, small data)."""
    w = Window.partitionBy(key).orderBy(*order)
    prev = F.lag("_s").over(w)
    flagged = df.withColumn("_s", seconds).withColumn(
        "_flag", F.when(prev.isNull() | (F.col("_s") - prev > gap_seconds), 1).otherwise(0))
    return flagged.withColumn(
        out, F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("bigint")
    ).drop("_s", "_flag")
