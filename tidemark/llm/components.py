"""Connected components of a graph given as an edge table.

Alternates two rounds of grouped minima: every node passes the least node it
sees to its larger neighbours, then to its smaller ones. The edge table never
grows, and it ends as one star per component. Each round is written to the
shared folder; the driver sees only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, store


def _round(edges: DataFrame, larger: bool) -> DataFrame:
    """One round over edges (a > b). Larger: the neighbours above a node get its minimum."""
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        moved = (
            edges.join(low, "a")
            .where("b > low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("a", F.col("low").alias("b")))
        )
    return moved.distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: BIGINT, not null) but the roots.

    root is the least node of the node's component. Loops and repeated edges do
    no harm; an empty table gives an empty result.
    """
    now = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "components",
    )
    mark = _mark(now)
    while mark[0]:
        new = store(_round(_round(now, larger=True), larger=False), "components")
        new_mark = _mark(new)
        if now.isEmpty() or new_mark == mark:
            forget(now)
            now = new
            break
        forget(now)
        now, mark = new, new_mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
