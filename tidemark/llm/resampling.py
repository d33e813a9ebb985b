"""Importance resampling towards a target: array-scored weights, then an LSD radix sort of the scores.

Features are the runs of words of a text, hashed to buckets; a bucket's gain is
the log-ratio of its smoothed frequency in the target and in all documents. The
counts of a bucket are added up over the tasks. A task holds the gains as one
array (10,000 numbers, whatever the input) and a document's weight is the sum of
the array's entries at its buckets. The score adds Gumbel noise from a digest
of the id, so that the highest scores are a draw without replacement in
proportion to exp(weight).

Scores are ranked by a distributed LSD radix sort. The composite key (score
falling, id rising with null last, number of features) is cut into digits of
``DIGIT_BITS`` bits at most, the lowest first. Every pass is a stable counting sort:
rows stand at positions in blocks of ``BLOCK``; the rows of each digit are counted in each block,
prefix sums over (digit, block) say where those of a block begin, and a row's
destination is that offset and its place among its block's rows of that digit.
A digit that all rows share is spread over the blocks, and no task holds more
than one block's rows of a digit as a group. Each pass is a written table. After
the last one the destination is the rank.

Defined results: a null text has no words; a null id counts as the empty text in the noise and ranks behind the other
ids of its score; rows equal in score, id and features are interchangeable, repeated rows are
each counted and ranked; without any document or target the counts are zero. Ids
are integers. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import forget, store, text_of

BUCKETS = 10_000
LONGEST_RUN = 1
LEAST_WORDS = 20
PER_CENT = 10
SEED = 2024
DIGIT_BITS = 11
BLOCK = 1 << 15
#: Small letters for A-Z and a space for every ASCII character that is neither letter nor digit.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Features whose buckets a task keeps at hand.
KNOWN = 1 << 20


class _Buckets(dict):
    def __missing__(self, feature: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % BUCKETS
        return found


def _featured(text: str, longest: int, known: _Buckets) -> tuple[int, np.ndarray]:
    """The number of words, and the buckets of all features."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    features = list(map(known.__getitem__, words))
    for n in range(2, longest + 1):
        features += [known[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return len(words), np.array(features, np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n): how many features of all texts a bucket holds; buckets without any are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _Buckets(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(_featured(text.as_py(), longest, known)[1], minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    return texts.select(text_of(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = LONGEST_RUN) -> list[int]:
    """The gain of every bucket; BUCKETS rows come to the driver, whatever the size of the tables."""
    own = dict(map(tuple, bucket_counts(docs, text_col, longest).collect()))
    wanted = dict(map(tuple, bucket_counts(target, text_col, longest).collect()))
    all_own, all_wanted = float(sum(own.values()) + BUCKETS), float(sum(wanted.values()) + BUCKETS)
    ratio = ((wanted.get(b, 0) + 1.0) * all_own / ((own.get(b, 0) + 1.0) * all_wanted) for b in range(BUCKETS))
    return [math.floor(1000 * math.log(x)) for x in ratio]


def scores(
    docs: DataFrame, gain: list[int], seed: int = SEED, longest: int = LONGEST_RUN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    import hashlib

    values = np.array(gain, np.int64)

    def noise(doc_id: int | None) -> int:
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for batch in batches:
            found = [_featured(t.as_py(), longest, known) for t in batch.column(1)]
            weights = np.array([values[f].sum() for _, f in found], np.int64)
            drawn = np.array([noise(i) for i in batch.column(0).to_pylist()], np.int64)
            columns = [[n for n, _ in found], [len(f) for _, f in found], weights, weights + drawn]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _digits(column: Column, low: int, high: int) -> list[Column]:
    """The digits of a whole number between low and high, lowest first, of about equal size."""
    bits = (high - low).bit_length()
    passes = math.ceil(bits / DIGIT_BITS)
    if not passes:
        return []
    width = math.ceil(bits / passes)
    above = column - F.lit(low)
    return [F.shiftright(above, width * k).bitwiseAND((1 << width) - 1).cast("int") for k in range(passes)]


def _pass(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable counting sort of rows (pos, ...) by a digit: the same rows with their destination as pos."""
    rows = rows.withColumns({"digit": digit, "block": F.floor(F.col("pos") / BLOCK)})
    counts = store(rows.groupBy("digit", "block").agg(F.count("*").alias("n")), "radix_counts")
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # one row for each value of a digit
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(totals, "digit")
    place = F.row_number().over(Window.partitionBy("digit", "block").orderBy("pos"))
    moved = rows.join(starts.select("digit", "block", (F.col("below") + F.col("earlier")).alias("start")), ["digit", "block"])
    out = store(moved.withColumn("pos", F.col("start") + place - 1).drop("digit", "block", "start"), "radix_pass")
    forget(counts)
    return out


def ranked(rows: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """``rows`` with pos, 0 for the first: sorted by integer columns (name, falling), the most significant first; nulls last.

    Only the extremes of the columns come to the driver.
    """
    asked = [f(c) for c, _ in keys for f in (F.min, F.max)]
    ends = rows.agg(*asked).first()
    current = store(rows.withColumn("pos", F.monotonically_increasing_id()), "radix_rows")
    for k, (name, falling) in reversed(list(enumerate(keys))):
        low, high = ends[2 * k], ends[2 * k + 1]
        if low is None:
            continue
        if high + 1 - low >= 1 << 63:
            raise ValueError(f"values of {name} span more than 63 bits")
        value = F.lit(high) + F.lit(low) - F.col(name) if falling else F.col(name)
        for digit in _digits(F.coalesce(value, F.lit(high + 1)), low, high + 1):
            done, current = current, _pass(current, digit)
            forget(done)
    return current


def resample(
    docs: DataFrame,
    target: DataFrame,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    per_cent: int = PER_CENT,
    longest: int = LONGEST_RUN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null for those that are not drawn)."""
    gain = gains(docs, target, text_col, longest)
    rows = store(scores(docs, gain, seed, longest, id_col, text_col), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    draw = per_cent * able.count() // 100
    order = ranked(able, [("score", True), ("doc_id", False), ("n_features", False)])
    rank = F.when(F.col("pos") < draw, F.col("pos") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    short = rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return order.select(*columns, rank.alias("rank")).unionByName(short)
