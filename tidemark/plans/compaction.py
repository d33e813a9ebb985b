"""Compaction of bronze batches into daily partitions.

Bronze keeps a partition per batch, so that a retried batch replaces its own
rows. Once batches are closed they are rewritten as one generation of their
ingest, whose batch id is the negative generation number, with a partition for
each day. The mark ``upto:generation`` of the table commits it:
from then on ``Lakehouse.table`` shows the generation in place of the batches up
to ``upto``, and ``overwrite_batch`` refuses to write one of them again. Before
the mark nothing has changed for readers; after it the old partitions are only
garbage. Both sides of it can be repeated after a failure. Readers that bypass
``Lakehouse.table`` must wait until the old partitions are gone.

Only batches that every incremental silver table has taken in are closed, and
the generation counts as taken in by them; a silver table that has not begun
yet reads it like any batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans import incremental
from tidemark.plans.catalog import COMPACTED, Lakehouse
from tidemark.session import delete_path


def _spec(values: dict) -> str:
    return ", ".join(f"{k} = NULL" if v is None else f"{k} = '{v}'" for k, v in values.items())


def _consumers(lh: Lakehouse, bronze: str) -> list[str]:
    """The incremental silver tables on a bronze table that have begun."""
    names = [incremental._consumed(t) for t, source in incremental.BRONZE.items() if source == bronze]
    return [n for n in names if lh.spark.catalog.tableExists(lh.name(n)) and not lh.table(n).isEmpty()]


def closed_upto(lh: Lakehouse, bronze: str, ingest_id: str) -> int:
    """The last batch that may be compacted: not the newest, and every batch up to it is taken in by all consumers."""
    own = incremental.bronze_batches(lh, bronze).filter((F.col("ingest_id") == ingest_id) & (F.col("batch_id") >= 0))
    open_from = [own.agg(F.max("batch_id")).first()[0]]
    for name in _consumers(lh, bronze):
        missing = own.join(lh.table(name), ["ingest_id", "batch_id"], "left_anti")
        open_from.append(missing.agg(F.min("batch_id")).first()[0])
    return min((b for b in open_from if b is not None), default=0) - 1


def compact(lh: Lakehouse, bronze: str, ingest_id: str, upto: int | None = None) -> int:
    """Rewrite the closed batches of an ingest into daily partitions; returns the last batch taken in (-1: none)."""
    if not bronze.startswith("bronze."):
        raise ValueError("only bronze tables have batches")
    before, generation = lh.compacted(bronze).get(ingest_id, (-1, 0))
    closed = closed_upto(lh, bronze, ingest_id)
    upto = closed if upto is None else min(upto, closed)
    if upto <= before:
        clean(lh, bronze, ingest_id)
        return before
    generation += 1
    rows = lh.table(bronze).filter((F.col("ingest_id") == ingest_id) & (F.col("batch_id") <= upto))
    # The batch id is below zero, which no reader is shown before the mark. A repeated try replaces its own rows.
    folder = f"{lh.path(bronze)}/ingest_id={ingest_id}/batch_id={-generation}"
    rest = [c for c in schemas.spec(bronze).partition_by if c not in schemas.STATIC_BRONZE_PARTITIONS]
    delete_path(lh.spark, folder)
    daily = rows.drop(*schemas.STATIC_BRONZE_PARTITIONS).hint("rebalance", *rest)
    daily.write.format(lh.fmt).partitionBy(*rest).save(folder)
    schema = rows.drop(*schemas.STATIC_BRONZE_PARTITIONS).schema
    days = lh.spark.read.format(lh.fmt).schema(schema).load(folder).select(*rest).distinct().collect()
    own = {"ingest_id": ingest_id, "batch_id": -generation}
    if days:
        added = " ".join(f"PARTITION ({_spec(own | d.asDict())})" for d in days)
        lh.spark.sql(f"ALTER TABLE {lh.name(bronze)} ADD IF NOT EXISTS {added}")
    mine = lh.spark.createDataFrame([(ingest_id, -generation)], schemas.CONSUMED)
    for name in _consumers(lh, bronze):
        lh.publish(name, lh.table(name).unionByName(mine).distinct())
    lh.mark(bronze, f"{COMPACTED}{ingest_id}", f"{upto}:{generation}")
    clean(lh, bronze, ingest_id)
    return upto


def clean(lh: Lakehouse, bronze: str, ingest_id: str) -> int:
    """Drop the partitions that a committed compaction has replaced; returns how many there were."""
    upto, generation = lh.compacted(bronze).get(ingest_id, (-1, 0))
    batch = F.regexp_extract("partition", r"batch_id=(-?\d+)", 1).cast("bigint")
    old = (batch.between(0, upto) | ((batch < 0) & (batch > -generation))) & F.col("partition").startswith(f"ingest_id={ingest_id}/")
    found = [r.partition for r in lh.spark.sql(f"SHOW PARTITIONS {lh.name(bronze)}").filter(old).collect()]
    if not found:
        return 0

    def parts(partition: str) -> dict[str, str | None]:
        named = (p.split("=", 1) for p in partition.split("/"))
        return {k: None if v == "__HIVE_DEFAULT_PARTITION__" else v for k, v in named}

    dropped = ", ".join(f"PARTITION ({_spec(parts(p))})" for p in found)
    lh.spark.sql(f"ALTER TABLE {lh.name(bronze)} DROP IF EXISTS {dropped}")
    for folder in {"/".join(p.split("/")[:2]) for p in found}:
        delete_path(lh.spark, f"{lh.path(bronze)}/{folder}")
    return len(found)
