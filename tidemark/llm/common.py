"""Helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_path

#: The characters that separate words everywhere in this package: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The folder outlives executors, so a lost executor costs only the tasks that
    were running. ``forget`` removes such a table once nothing reads it.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", label, unique=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``store``."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row of ``docs`` as one struct ``all`` beside ``columns``: its own names clash with none; ``select("all.*")`` unpacks it."""
    own = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    return docs.select(F.struct(*own).alias("all"), *[c.alias(name) for name, c in columns.items()])


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a value's text modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
