"""Exact duplicates by deterministic block naming.

The normalised text (white space deleted) is cut into blocks of a fixed number
of code points. All distinct blocks are sorted into integer names; then adjacent
names of a document are paired and the distinct pairs named in the same way,
until one name is left for each document. Two documents have the same name on
the same level if and only if their normalised texts are equal: names are given
to contents, never to hashes of them.

A block's text is shuffled once, after a map-side combine, so a text that fills
a third of the table reaches its reducer once for each map task. All later
tables hold integers only. Rows of one document id, text and length are carried
as one row with a count.

Defined results: a null text counts as empty, all texts without any character
left are one group; a null doc_id ranks after all others; of rows that repeat
both doc_id and text length within a group, exactly one is kept. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, forget, packed, store, text_of

BLOCK = 16_384
KEY = ["doc_id", "text_sha256", "n_points"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256, n_points (of the original text) and body (the normalised text)."""
    text = text_of(text_col)
    body = F.translate(text, SPACES, "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(body.cast("binary"), 256).alias("text_sha256"),
        F.length(text).alias("n_points"),
        body.alias("body"),
    )


def _name(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Sort distinct rows within their partitions and number them; the store makes the names final."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, text_sha256, n_points, copies (equal rows), level, name; (level, name) is the text's identity."""
    blocks = F.when(F.length("body") <= block, F.array("body")).otherwise(
        F.regexp_extract_all("body", F.lit(f"(?s).{{1,{block}}}+"), F.lit(0))
    )
    # Written once: normalising and hashing the texts costs more than reading the blocks back.
    pieces = store(
        keyed(docs, id_col, text_col)
        .select(*KEY, blocks.alias("blocks"))
        .select(*KEY, F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
        .withColumn("digest", F.md5(F.col("block").cast("binary"))),
        "pieces",
    )
    # The digest only saves shipping the text a second time. Should two blocks ever share one, the join is on the text.
    match = ["digest"]
    names = store(_name(pieces.select("digest", "block").distinct(), ["block"]).select("digest", "name"), "names")
    if not names.groupBy("digest").count().where("count > 1").isEmpty():
        match = ["digest", "block"]
        names = store(_name(pieces.select(*match).distinct(), ["block"]), "names")
    current = store(
        pieces.groupBy(*KEY, "n", "pos", *match)
        .agg(F.count("*").alias("copies"))
        .join(names, match)
        .select(*KEY, "copies", "n", "pos", "name"),
        "level",
    )
    forget(names)
    forget(pieces)
    done = [current.where("n = 1").select(*KEY, "copies", F.lit(0).alias("level"), "name")]
    most, level = current.agg(F.max("n")).first()[0] or 1, 0
    while most > 1:
        level, most = level + 1, ceil(most / 2)
        half = F.floor(F.col("pos") / 2)
        pairs = (
            current.where("n > 1")
            .groupBy(*KEY, "copies", F.ceil(F.col("n") / 2).cast("int").alias("n"), half.cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        names = store(_name(pairs.select("left", "right").distinct(), ["left", "right"]), "names")
        current = store(pairs.join(names, ["left", "right"]).select(*KEY, "copies", "n", "pos", "name"), "level")
        done.append(current.where("n = 1").select(*KEY, "copies", F.lit(level).alias("level"), "name"))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """identities() with keep_id, group_size and kept, which marks the row whose first copy stays."""
    found = identities(docs, id_col, text_col, block)
    best = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"))
    groups = found.groupBy("level", "name").agg(F.sum("copies").alias("group_size"), F.min(best).alias("best"))
    return found.join(groups, ["level", "name"]).select(
        *KEY,
        "copies",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n_points") == -F.col("best.n"))).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = decisions(docs, id_col, text_col).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("kept") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one for each normalised text."""
    from pyspark.sql import Window

    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    kept = decisions(docs, id_col, text_col).where("kept").select(own.alias("id"), F.col("text_sha256").alias("sha"), F.col("n_points").alias("n"))
    text = text_of(text_col)
    rows = packed(
        docs,
        id=F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        sha=F.sha2(F.translate(text, SPACES, "").cast("binary"), 256),
        n=F.length(text),
    )
    first = F.row_number().over(Window.partitionBy("id", "sha", "n").orderBy("n"))
    return rows.join(kept, ["id", "sha", "n"], "left_semi").withColumn("first", first).where("first = 1").select("all.*")
