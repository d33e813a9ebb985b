"""A corpus pipeline of five operators: STAGES in order, run() over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``. No SQL statement
expresses the n-gram filters and the tokenizer, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, langid, mixing, simhash
from tidemark.llm.common import store, table
from tidemark.llm.queries import tokenizer_path

#: The language stage rejects texts without a letter, and those of whose n-grams no language knows this share.
LEAST_LANGUAGE_SCORE = 0.05
#: A worker's tables of words and chunks: after four stages an executor's heap is at its full size beside them.
BPE_CACHE_BYTES = 40 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, LEAST_LANGUAGE_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, tokenizer_path(), cache_bytes=BPE_CACHE_BYTES)


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("source mixing", mixed), ("BPE", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, name.replace(" ", "_"))
    return docs
