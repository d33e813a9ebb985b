"""The deal of texts before BPE: each text is cut and hashed once, no row is lost, a large group of copies is spread."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import bpe


def test_every_text_is_hashed_once_and_copies_are_spread(utc):
    texts = utc.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 200)).alias("text"))
    copies = utc.range(1000, 1600).select(F.col("id").alias("doc_id"), F.lit("the same words again " * 40).alias("text"))
    dealt = bpe._dealt(texts.union(copies).union(copies.limit(1)))
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [__least" not in plan  # Spark's own ranges run the plan behind them once more
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1001 and len(sizes) == 4 and max(sizes) < 400
    assert bpe._dealt(texts.limit(0)).count() == 0
