"""Near-duplicate texts by SimHash and multi-index hashing.

Fingerprints are computed in Arrow batches. The distinct fingerprints are then
cut into four segments of 16 bits; for every segment the Hamming ball of radius
one around its value is enumerated, and the segment with each of its ball's
values, beside the other segments as they are, is a key of the index. Two
fingerprints that differ in at most two bits always share a key: the one that
has the first differing bit flipped. Whoever shares a key is linked to the
least fingerprint of that key after the complete distance has been verified.

A key is shared by 65 fingerprints at most, however many copies a text has, so
no bucket grows with the data: a group of near copies costs 65 rows for each
distinct fingerprint and never all its pairs.

Defined results: a null or wordless text has fingerprint zero, which is linked
like any other; a null doc_id takes part but is never a component's smallest
id unless all its ids are null; repeated rows are all returned. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed, store, text_of
from tidemark.llm.components import components

SEED = 42
SHINGLE = 3
SEGMENTS, SEGMENT_BITS = 4, 16
#: ASCII capitals to small letters, and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), STEP):
        spans = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.dtype("<u8"))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed BIGINT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def links(distinct: DataFrame, differing: int = 2) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` within two bits of each other, linear in their number."""
    if differing != 2:
        raise ValueError("balls of radius one in each segment cover two differing bits")
    flips = [1 << (s * SEGMENT_BITS + i) for s in range(SEGMENTS) for i in range(SEGMENT_BITS)]
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in [0, *flips]))
    # A fingerprint becomes 65 rows here: few and small partitions of fingerprints would be few tasks.
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = spread.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), "fp")
    met = keys.groupBy("key").agg(F.collect_set("fp").alias("met")).where("size(met) > 1")
    pairs = met.select(F.explode("met").alias("a"), F.array_min("met").alias("b")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= differing).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    rows = store(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    members = store(
        distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "members"
    )
    lowest = members.groupBy("root").agg(F.min("low").alias("component_id"))
    named = members.join(lowest, "root").select("fp", "component_id")
    out = rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each component.

    It is the row of the least id, null last; of rows with equal ids the text's digest decides, and of rows equal in
    both any one stays.
    """
    tie = F.md5(text_of(text_col).cast("binary"))
    rows = packed(docs, none=F.col(id_col).isNull(), id=F.col(id_col), tie=tie, text=F.col(text_col))
    decided = near_duplicates(rows.select(F.struct("none", "id", "tie").alias("rank"), "text"), "rank")
    keep = decided.where("doc_id = component_id").select("doc_id.*").distinct()
    keep = keep.select(F.col("none").alias("k_none"), F.col("id").alias("k_id"), F.col("tie").alias("k_tie"))
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie"))
    one = F.row_number().over(Window.partitionBy("id", "tie").orderBy("none"))
    return rows.drop("text").join(keep, same, "left_semi").withColumn("one", one).where("one = 1").select("all.*")
