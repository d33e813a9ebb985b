"""Distinct counts that can be merged (A2).

A mart that counts distinct users per day cannot be added up over days. Two
forms of partial results can:

* **Exact.** A dictionary gives every value a code; a partial result is a set of
  bitmaps over the codes, one for each 32,768 of them (``bitmap_construct_agg``).
  Merging is a bitwise or, and the count is a popcount. Codes are dense within
  the tasks that made them, so that bitmaps are full where values are many.
* **Sketched** (opt-in). A HyperLogLog sketch per group, of fixed size whatever
  the count, merged by union; ``lg_k`` bits of precision give a relative
  standard error of about ``1.04 / sqrt(2 ** lg_k)``.

Both are partial aggregates, combined before the shuffle. NULL values are not
counted; a group of only NULLs has no partial result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def new_codes(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(value, code) for the distinct non-NULL values of a one-column frame that ``known`` lacks.

    The codes begin behind all known ones. They are final once the result is
    written; ``known`` together with it is the next dictionary."""
    fresh = values.toDF("value").filter(F.col("value").isNotNull()).distinct()
    base = F.lit(0).cast("bigint")
    if known is not None:
        fresh = fresh.join(known, "value", "left_anti")
        last = known.agg(F.max("code")).first()[0]
        # Codes rise from a multiple of 2^33 in each task.
        base = F.lit(0 if last is None else ((last >> 33) + 1) << 33).cast("bigint")
    return fresh.select("value", (F.monotonically_increasing_id() + base).alias("code"))


def bitmaps(rows: DataFrame, keys: Sequence[str], value: str, codes: DataFrame) -> DataFrame:
    """Partial results: (keys, bucket, bitmap) of the values of each group."""
    coded = rows.select(*keys, F.col(value).alias("value")).join(codes, "value").drop("value")
    return coded.groupBy(*keys, F.bitmap_bucket_number("code").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bitmap"))


def merged_count(partial: DataFrame, keys: Sequence[str], out: str = "count") -> DataFrame:
    """Exact distinct counts of coarser groups from ``bitmaps``."""
    whole = partial.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return whole.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias(out))


def sketches(rows: DataFrame, keys: Sequence[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """Partial results: (keys, sketch) of the values of each group."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged_estimate(partial: DataFrame, keys: Sequence[str], out: str = "count") -> DataFrame:
    """Estimated distinct counts of coarser groups from ``sketches``."""
    return partial.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))


def rolling(partial: DataFrame, days: int, day: str = "dt") -> DataFrame:
    """Each partial result of a day under every day whose window of ``days`` days it falls into."""
    ahead = F.sequence(F.col(day), F.date_add(F.col(day), days - 1))
    return partial.withColumn(day, F.explode(ahead))


def rolling_users(events: DataFrame, codes: DataFrame, days: int = 7) -> DataFrame:
    """Per day the distinct users of that day and the ``days - 1`` before it, from one set of bitmaps per day.

    Days without any event have no row."""
    daily = bitmaps(events.filter(F.col("dt").isNotNull()), ["dt"], "user_id", codes)
    active = events.select("dt").distinct()
    counts = merged_count(rolling(daily, days), ["dt"], "users")
    return active.filter(F.col("dt").isNotNull()).join(counts, "dt", "left").select("dt", _or_zero("users"))


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
