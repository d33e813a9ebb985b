"""Mixing sources to target weights.

Every document gets a hash-random key; within its source the keys are cut into
4,096 ranges, sorted within each range, and summed up: a running sum inside a
range plus the totals of the ranges before it is the distributed prefix sum of
the source's words. A source whose target exceeds its size is repeated for whole
epochs, and the last epoch is cut at the exact word at which the budget ends, so
the words taken of a source are the whole part of its target.

Targets: the n-th source by code point (null last) weighs 1, 2, 3, 1, ...; the
sum of all sizes is shared by weight, but no source gets more than three times
its size. Sharing the excess again until no source is above ends at one level L
with target = min(3 x size, L x weight); it is found by sorting the sources by
3 x size / weight.

Only (source, key, size) rows are shuffled. A hot source is spread over 4,096
ranges, a hash of id, source and text, so that rows that lack an id spread as well.

Defined results: a null text has size 0 and nothing is taken of it; a source of
size 0 has target 0; rows equal in id, source and text are interchangeable; reruns
agree as the key is a digest. An empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, packed, store, text_of

MOST_EPOCHS = 3
RANGE_DIGITS = 3  # leading hex digits of the key: 16**3 ranges a source


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    """A digest of id, source and text; rows that agree in all three are interchangeable."""
    doc, source = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    return F.md5(F.concat(doc, F.lit(":"), source, F.lit(":"), text_of(text_col)).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target (double) and budget (long) from one row per source."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.select("source", "source_size", (1 + (F.row_number().over(by_name) - 1) % 3).cast("bigint").alias("w"))
    limit = F.col("source_size") * MOST_EPOCHS
    # Sources in the order in which a rising level reaches their limits.
    reached = Window.orderBy("ratio", "source_size", "w", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    ranked = weighed.withColumns({"limit": limit, "ratio": limit / F.col("w"), "total": F.sum("source_size").over(every)})
    ranked = ranked.withColumns(
        {
            "spent": F.coalesce(F.sum("limit").over(reached), F.lit(0)),
            "left_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(reached), F.lit(0)),
        }
    )
    # A source is at its limit if the level, were it and all after it free, would reach it.
    capped = (F.col("total") - F.col("spent")) * F.col("w") >= F.col("limit") * F.col("left_w")
    ranked = ranked.withColumn("capped", capped)
    free = F.when(~F.col("capped"), F.struct("ratio", "spent", "left_w"))
    ranked = ranked.withColumn("at", F.min(free).over(every))
    shared = (F.col("w") * (F.col("total") - F.col("at.spent"))).cast("double") / F.col("at.left_w")
    target = F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(shared)
    return ranked.select("source", "source_size", target.alias("target")).withColumn("budget", F.floor("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken; and key, by which rows can be told apart."""
    sized = store(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("size"),
            _key(id_col, text_col, source_col).alias("key"),
        ),
        "sized",
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    plan = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    offsets = offsets.join(plan, offsets["source"].eqNullSafe(plan["source"])).select(
        offsets["source"].alias("o_source"), F.col("range").alias("o_range"), "offset", "source_size", "target", "budget"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, (F.col("range") == F.col("o_range")) & F.col("source").eqNullSafe(F.col("o_source")))
    before = F.col("offset") + F.col("inside")
    epochs = F.expr("CASE WHEN source_size > 0 THEN budget div source_size ELSE 0 END")
    rest = F.col("budget") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("bigint").alias("taken"), "key"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents with all columns of ``docs``: a row for each epoch in which words of the document are taken.

    Documents stay whole: the one at which a budget ends is taken with all its words in its last epoch.
    """
    taken = mix(docs, id_col, text_col, source_col).where("taken > 0")
    times = taken.select("key", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    # Rows of one key are equal in id, text and size; their epochs may differ by one, in any order.
    times = times.groupBy("key").agg(F.sum("times").alias("sum"), F.count("*").alias("rows"))
    order = Window.partitionBy("key").orderBy("sum")
    rows = packed(docs, key=_key(id_col, text_col, source_col)).join(times, "key").withColumn("nth", F.row_number().over(order))
    whole = F.expr("cast(sum div rows as int)") + (F.col("nth") <= F.expr("sum % rows")).cast("int")
    rows = rows.withColumn("times", whole).where("times > 0")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), "times"))).select("all.*")
