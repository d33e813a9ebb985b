"""Column statistics by partition.

``ANALYZE TABLE`` reads every column of a table on each run. Here a table's
statistics are kept per day and column: rows, NULLs, least and greatest value
and a sketch of the distinct values. A run reads only the days it is given, or
those it has none for, and statistics of the whole table are combined from the kept rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators.distinct import LG_K
from tidemark.plans.catalog import Lakehouse

STATE = "state.column_statistics"
ORDERED = (T.StringType, T.DateType, T.TimestampType)


def _bounds(name: str, dtype: T.DataType) -> list:
    """Least and greatest value: numbers as DECIMAL(38,6), others as text in their own order."""
    column = F.col(name)
    if isinstance(dtype, T.NumericType):
        wide = column.cast("decimal(38,6)")
        return [F.min(wide), F.max(wide), F.lit(None).cast("string"), F.lit(None).cast("string")]
    text = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS") if isinstance(dtype, T.TimestampType) else column.cast("string")
    none = F.lit(None).cast("decimal(38,6)")
    return [none, none, F.min(text), F.max(text)]


def day_statistics(rows: DataFrame, logical: str, day: str | None) -> DataFrame:
    """(table, dt, column, rows, nulls, bounds, sketch) of the given rows, all columns in one pass."""
    fields = [f for f in rows.schema.fields if f.name != day]
    each = []
    for f in fields:
        low, high, low_text, high_text = _bounds(f.name, f.dataType)
        each.append(F.struct(
            F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(f.name).isNull()).alias("nulls"),
            low.alias("low"), high.alias("high"), low_text.alias("low_text"), high_text.alias("high_text"),
            F.hll_sketch_agg(F.col(f.name).cast("string"), F.lit(LG_K)).alias("sketch")))
    key = F.col(day) if day else F.lit(None).cast("date")
    grouped = rows.groupBy(key.alias("dt")).agg(F.array(*each).alias("each"))
    return grouped.select(F.lit(logical).alias("table_name"), "dt", F.explode("each").alias("s")).select("table_name", "dt", "s.*")


def update_statistics(lh: Lakehouse, logical: str, days: set[_dt.date] | None = None) -> set[_dt.date | None]:
    """Bring a table's statistics up to date; returns the days that were read.

    ``days`` are those that have changed; days without statistics are read as
    well, and days that are gone lose theirs. A table without days is read whole."""
    lh.init([logical, STATE])
    daily = "dt" in schemas.spec(logical).partition_by
    table, kept = lh.table(logical), lh.table(STATE)
    if not daily:
        fresh = day_statistics(table, logical, None)
        lh.publish(STATE, kept.filter(F.col("table_name") != logical).unionByName(fresh))
        return {None}
    # The days of a table are its partitions: their list comes from the folders, not from the rows.
    now = {r.dt for r in table.select("dt").distinct().collect()}
    known = {r.dt for r in kept.filter(F.col("table_name") == logical).select("dt").distinct().collect()}
    read = (now - known) | ((days or set()) & now)
    gone = (known - now) | read
    if not gone:
        return set()
    stale = F.col("dt").isin([d for d in gone if d is not None]) | (F.lit(None in gone) & F.col("dt").isNull())
    others = kept.filter((F.col("table_name") != logical) | ~F.coalesce(stale, F.lit(False)))
    wanted = table.filter(F.coalesce(F.col("dt").isin([d for d in read if d is not None]), F.lit(None in read)))
    lh.publish(STATE, others.unionByName(day_statistics(wanted, logical, "dt")))
    return read


def column_statistics(lh: Lakehouse, logical: str) -> DataFrame:
    """Per column of a table: rows, nulls, least and greatest value as text, estimated distinct values."""
    kept = lh.table(STATE).filter(F.col("table_name") == logical)
    return kept.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.coalesce(F.min("low").cast("string"), F.min("low_text")).alias("low"),
        F.coalesce(F.max("high").cast("string"), F.max("high_text")).alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
