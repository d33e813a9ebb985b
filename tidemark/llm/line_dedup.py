"""Repeated lines: digests grouped globally, the earliest ranked occurrence kept.

Every line of a text is a unit, with its number and its offsets in the original
text (code points, end exclusive). Its normal form is lower case with runs of
white space as one space and none at the ends; units with fewer than MIN_WORDS
words are left alone, as short ones repeat by chance. Units are grouped by the
SHA-256 of their normal form; the one of the smallest (doc_id, line) stays.

The group's earliest occurrence is a minimum over narrow rows, combined before
the shuffle, so a line that stands in a third of all texts is one row a task.
The join back to the units splits hot digests by Spark's skewed joins.

Defined results: a null text has no line; a null doc_id ranks last; of rows with
equal doc_id the line number decides, and equal rows share one rank, so that
repeated rows keep the same units. An empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import store, text_of

MIN_WORDS = 8


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line, start, stop and digest of every unit that takes part."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.split(text_of(text_col), "\n").alias("lines"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc, line):  # noqa: ANN001, ANN202
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    placed = lines.withColumn("starts", F.aggregate("lines", zero, step, lambda acc: acc["starts"]))
    rows = placed.select("doc_id", F.posexplode(F.arrays_zip("lines", "starts")).alias("line", "x"))
    normal = F.lower(F.trim(F.regexp_replace("x.lines", r"[\x20\x09-\x0D]+", " ")))
    rows = rows.select("doc_id", "line", F.col("x.starts").alias("start"), F.length("x.lines").alias("n"), normal.alias("unit"))
    words = F.length("unit") - F.length(F.replace(F.col("unit"), F.lit(" "))) + 1
    rows = rows.where((F.col("unit") != "") & (words >= min_words))
    return rows.select(
        "doc_id", "line", "start", (F.col("start") + F.col("n")).alias("stop"), F.sha2(F.col("unit").cast("binary"), 256).alias("digest")
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed unit: doc_id, line, start, stop, digest, and keep_doc_id and keep_line of the one that stays."""
    found = store(units(docs, id_col, text_col, min_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("line").alias("line"))
    groups = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = found.join(groups.select("digest", "first"), "digest")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("line") == F.col("first.line")))
    return rows.where(other).select(
        "doc_id", "line", "start", "stop", "digest", F.col("first.id").alias("keep_doc_id"), F.col("first.line").alias("keep_line")
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text and spans: the texts without their removed lines, and the removed lines' offsets in the original.

    Texts are found by id, so ids must be unique and not null here.
    """
    gone = repeats(docs, id_col, text_col, min_words)
    gone = gone.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_set(F.struct("line", "start", "stop"))).alias("__gone"))
    rows = docs.join(gone, docs[id_col] == F.col("__id"), "left")
    spans = F.coalesce("__gone", F.array().cast("array<struct<line:int,start:int,stop:int>>"))
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), spans.alias("spans"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.transform("spans", lambda s: s["line"]), i))
    return rows.select("doc_id", F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")).alias("text"), "spans")
