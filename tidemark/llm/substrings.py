"""Removal of repeated substrings by suffix arrays over shards.

A window is a string of WIDTH bytes. In every window one place is marked: the
least hash of its GRAM-byte strings, the leftmost of equals. Equal windows have
equal marks, so equal windows can only be found under one mark; and a mark that
occurs once in all texts has no repeated window. This deals the work out:

1. One scan lists the marks of every text; they are counted globally.
2. Texts with marks that occur again are joined with those marks. For each, the
   segment is cut that covers exactly the windows of this mark. Equal segments
   collapse to one with a count, before they are shuffled. A mark that occurs
   more than HOT times does not gather its segments: its windows are cut one by
   one, each known by its 128-bit name alone, and counted like any other key.
3. Segments are dealt by mark and sorted, so that a task reads all segments of a
   mark in sequence; it packs them into shards of SHARD_BYTES, builds the suffix
   array of each by induced sorting, and reads off the permuted common prefixes
   which windows occur again.
4. The windows found go back to their texts, whose covered bytes are removed.

Texts are known by the SHA-256 of their bytes, so equal rows cost one digest
each; a text that occurs twice is removed as a whole.

Every document returns: a null text counts as empty, a text shorter than a
window is left as it is, repeated rows remove each other, matches never cross
documents, a null doc_id is passed through. An empty table gives an empty
result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import store
from tidemark.llm.rolling import STEP, rolling
from tidemark.llm.suffixes import permuted_prefixes, suffix_array

WIDTH = 200
GRAM = 100
#: What a worker sorts at once; larger shards leave its cache and take twice the time a byte.
SHARD_BYTES = 256 << 10
#: Segments of a mark that one task may gather: at most 5 MB beside the shard.
HOT = 1 << 14
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
PLACE = np.uint64((1 << 24) - 1)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` adjacent keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def marks(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): for each mark its hash and the first window that has it; the next mark's start ends its run."""
    hashes, starts, last = [], [], -1
    for at in range(0, len(raw) - width + 1, STEP):
        part = np.frombuffer(raw, np.uint8)[at : at + STEP + width - 1]
        rolled = rolling(part, gram)
        least = _least(rolled & ~PLACE | np.arange(len(rolled), dtype=np.uint64), width - gram + 1)
        where = (least & PLACE).astype(np.int64)
        new = np.flatnonzero(np.diff(where, prepend=last - at))
        last = int(where[-1]) + at
        hashes.append(rolled[where[new]])
        starts.append(new + at)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes).view(np.int64), np.concatenate(starts)


def _marked(texts: DataFrame) -> DataFrame:
    """doc_id, sha, n_bytes, and the arrays marks and starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, sizes, hashes, starts = [], [], [], []
            for text in batch.column(1):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                h, s = marks(raw)
                shas.append(hashlib.sha256(raw).hexdigest())
                sizes.append(len(raw))
                hashes.append(h)
                starts.append(s.astype(np.int32))
            columns = [pa.array(shas, pa.string()), pa.array(sizes, pa.int64())]
            columns += [pa.array(hashes, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "sha", "n_bytes", "marks", "starts"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, sha string, n_bytes bigint, marks array<bigint>, starts array<int>")


def _segments(found: DataFrame) -> DataFrame:
    """From (row, text, hits: array of (start, stop, mark, hot)) the segments: mark, a 128-bit name, bytes, row and start.

    A hot hit gives its windows one by one: half of the name in place of the mark, and no bytes.
    """

    def packed(cuts: list[bytes], digests: list[bytes], columns: list[list[int]]) -> pa.RecordBatch:
        names = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        rows, starts, marks, hot = (np.array(c, np.int64) for c in columns)
        arrays = [np.where(hot == 1, names[:, 0], marks), names[:, 0], names[:, 1], pa.array(cuts, pa.binary()), rows, starts.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["mark", "name1", "name2", "bytes", "row", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            hits = batch.column(2)
            ends = (hits.offsets.to_numpy() - hits.offsets[0].as_py()).tolist()
            every = [hits.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("start", "stop", "mark", "hot")]
            cuts, digests, columns = [], [], [[], [], [], []]
            for k, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for first, last, mark, hot in zip(*(x[ends[k] : ends[k + 1]].tolist() for x in every), strict=True):
                    for start, stop in ((w, w) for w in range(first, last + 1)) if hot else ((first, last),):
                        cut = raw[start : stop + WIDTH]
                        digests.append(digest(cut))
                        cuts.append(b"" if hot else cut)
                        for column, value in zip(columns, (row, start, mark, hot), strict=True):
                            column.append(value)
                if len(cuts) >= 10_000:
                    yield packed(cuts, digests, columns)
                    cuts, digests, columns = [], [], [[], [], [], []]
            if cuts:
                yield packed(cuts, digests, columns)

    return found.select("row", "text", "hits").mapInArrow(
        run, "mark bigint, name1 bigint, name2 bigint, bytes binary, row bigint, start int"
    )


def repeated_windows(segments: list[bytes], counts: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each segment of a shard, which of its windows occur twice or more in the shard; counts: of equal segments."""
    lengths = np.array([len(s) for s in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    common, before = permuted_prefixes(raw, suffix_array(raw))
    left = np.repeat(starts + lengths, lengths + 1) - np.arange(len(raw))  # bytes to the segment's end
    hit = np.flatnonzero((common >= width) & (left >= width))
    flag = np.zeros(len(raw), bool)
    flag[hit] = True
    flag[before[hit]] = True
    out = []
    for at, n, count in zip(starts.tolist(), lengths.tolist(), counts, strict=True):
        windows = n - width + 1
        out.append(np.ones(windows, bool) if count > 1 else flag[at : at + windows])
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _repeated(segments: DataFrame) -> DataFrame:
    """name1, name2, first, last: runs of repeated windows within each distinct segment."""

    def told(rows: list[tuple], found: list[np.ndarray]) -> pa.RecordBatch:
        runs = [_runs(f) for f in found]
        sizes = [len(a) for a, _ in runs]
        names = [np.repeat(np.array([r[k] for r in rows], np.int64), sizes) for k in (1, 2)]
        ends = [np.concatenate([r[k] for r in runs]).astype(np.int32) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*names, *ends)], names=["name1", "name2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []  # the segments of the mark that is being read
        rows: list[tuple] = []  # the segments of the shard
        alone: list[tuple] = []  # windows of hot marks, and segments that are the only ones of their mark, copies aside
        size = 0

        def settle(group: list[tuple]) -> None:
            nonlocal size
            alone.extend(r for r in group if not r[3] and r[4] > 1)
            group = [r for r in group if r[3]]
            if len(group) > 1:
                rows.extend(group)
                size += sum(len(r[3]) for r in group)
            elif group and group[0][4] > 1:  # else no window of it occurs twice: its second place would be a segment too
                alone.extend(group)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if group and group[0][0] != row[0]:
                    settle(group)
                    group = []
                    if size > SHARD_BYTES:
                        yield told(rows, repeated_windows([r[3] for r in rows], [r[4] for r in rows]))
                        rows.clear()
                        size = 0
                group.append(row)
            if alone:
                yield told(alone, [np.ones(max(1, len(r[3]) - WIDTH + 1), bool) for r in alone])
                alone.clear()
        if group:
            settle(group)
        if alone:
            yield told(alone, [np.ones(max(1, len(r[3]) - WIDTH + 1), bool) for r in alone])
        if rows:
            yield told(rows, repeated_windows([r[3] for r in rows], [r[4] for r in rows]))

    distinct = segments.groupBy("mark", "name1", "name2", "bytes").agg(F.count("*").alias("n"))
    return (
        distinct.repartition("mark")
        .sortWithinPartitions("mark")
        .mapInArrow(run, "name1 bigint, name2 bigint, first int, last int")
    )


def _cleaned(texts: DataFrame) -> DataFrame:
    """From (sha, text, windows: array of (first, last)) sha, n_removed, n_spans, kept_sha256, kept, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, text, windows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                step = np.zeros(len(raw) + 1, np.int32)
                np.add.at(step, [w["first"] for w in windows], 1)
                np.add.at(step, [w["last"] + WIDTH for w in windows], -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                first, last = _runs(gone)
                spans = [{"start": int(a), "stop": int(b) + 1} for a, b in zip(first, last, strict=True)]
                rows.append((sha, int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
            )

    names = ["sha", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span]
    schema = "sha string, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<struct<start:int,stop:int>>"
    return texts.select("sha", "text", "windows").mapInArrow(run, schema)


def repeated_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> tuple[DataFrame, DataFrame]:
    """(documents, changed): per input row doc_id, sha, n_bytes, copies; per text with removed bytes what _cleaned gives.

    Texts that occur more than once are in neither their spans nor their kept bytes listed: they go as a whole.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = store(_marked(texts).withColumn("row", F.monotonically_increasing_id()), "marked")
    copies = marked.groupBy("sha").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    stop = F.coalesce(F.try_element_at("starts", F.col("i") + 2) - 1, F.col("n_bytes").cast("int") - WIDTH)
    each = (
        marked.join(copies.select("row"), "row", "left_semi")
        .select("row", "sha", "n_bytes", "starts", F.posexplode("marks").alias("i", "mark"))
        .select("row", "mark", F.element_at("starts", F.col("i") + 1).alias("start"), stop.alias("stop"))
    )
    # A table, so that both sides of the join are plain exchanges and a mark that stands in very many texts can be split.
    again = store(each.groupBy("mark").agg((F.count("*") > hot).alias("hot"), F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    hits = each.join(again, "mark").groupBy("row").agg(F.collect_list(F.struct("start", "stop", "mark", "hot")).alias("hits"))
    hits = marked.select("row", "sha").join(hits, "row").join(copies.select("row", "copies"), "row")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    found = store(texts.select(digest.alias("sha"), "text").join(hits, "sha"), "found")
    # A text that occurs again goes as a whole; its segments only tell that their windows do, too.
    places = _segments(found.where("copies = 1")).select("name1", "name2", "row", "start")
    windows = (
        places.join(_repeated(_segments(found)), ["name1", "name2"])
        .groupBy("row")
        .agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))).alias("windows"))
    )
    changed = _cleaned(found.where("copies = 1").select("row", "sha", "text").join(windows, "row"))
    documents = marked.select("doc_id", "sha", "n_bytes").join(copies.select("sha", "copies"), "sha")
    return documents, changed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    documents, changed = repeated_substrings(docs, id_col, text_col, hot)
    changed = changed.select("sha", "n_removed", "n_spans", "kept_sha256")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= WIDTH)
    return documents.join(changed, "sha", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
