"""Repeated passages: digests of paragraphs, lines and sentences, the earliest occurrence kept.

Units are the paragraphs of a text (cut at blank lines), its lines, and the
sentences within a line. No unit is left out for its length: a sentence of
fewer than CONTEXT words is widened by the sentences after it in its line, and
at the line's end by those before it, until it has as many or is the line. So a
short phrase is judged with its neighbours, and a passage is found wherever a
unit begins and ends with it, whatever stands around it. A passage of which no
unit lies whole within it is not found.

A unit's offsets are code points of the original text, end exclusive, without
white space at the ends. Its normal form is lower case with runs of white space
as one space; units of equal normal form are one group on all levels, known by
128 bits of its hash. The one of the least (doc_id, nulls last; hash of the
text; row; start) stays. A removed place always repeats an earlier one, so one
copy of everything stays.

A group with most of the rows is no single task's: counts and minima are combined
before the shuffle, and the join back splits hot digests by Spark's skewed joins.
Rows that agree in id and text are carried as one with their number; of these
the first is judged like any other, and all units of the rest repeat it.

Defined results: a null text has no unit and nothing removed; a null id ranks
last; repeated rows keep one copy of their units between them; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, forget, store, text_of

CONTEXT = 8
SPACE = r"[\x20\x09-\x0D]"
PARAGRAPH = re.compile(r"\n(?:[\x20\x09\x0B-\x0D]*\n)+")
LINE = re.compile(r"\n")
SENTENCE = re.compile(rf"(?<=[.!?…。！？]){SPACE}+")
#: A document (id and text) and a unit's normal form are each known by two 64-bit hashes.
DOC, DIGEST = ["d1", "d2"], ["h1", "h2"]
UNIT = "d1 bigint, d2 bigint, start int, stop int, h1 bigint, h2 bigint"
SPANS = "array<struct<start:int,stop:int>>"


def _cut(text: str, border: re.Pattern, start: int, stop: int) -> list[tuple[int, int]]:
    """The parts of text[start:stop] between borders that are not white space, trimmed."""
    found, at = [], start
    for a, b in [*(m.span() for m in border.finditer(text, start, stop)), (stop, stop)]:
        part = text[at:a]
        left = len(part) - len(part.lstrip(SPACES))
        if left < len(part):
            found.append((at + left, at + len(part.rstrip(SPACES))))
        at = b
    return found


def spans(text: str) -> set[tuple[int, int]]:
    """Offsets of all units of a text."""
    found = set(_cut(text, PARAGRAPH, 0, len(text)))
    for start, stop in _cut(text, LINE, 0, len(text)):
        found.add((start, stop))
        parts = _cut(text, SENTENCE, start, stop)
        size = [len(text[a:b].split()) for a, b in parts]
        for i in range(len(parts)):
            first, last, words = i, i, size[i]
            while words < CONTEXT and last + 1 < len(parts):
                last += 1
                words += size[last]
            while words < CONTEXT and first:
                first -= 1
                words += size[first]
            found.add((parts[first][0], parts[last][1]))
    return found


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    normal = re.compile(f"{SPACE}+")
    for batch in batches:
        of, starts, stops, digests = [], [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            for a, b in sorted(spans(text)):
                of.append(row)
                starts.append(a)
                stops.append(b)
                digests.append(xxhash.xxh128_digest(normal.sub(" ", text[a:b]).lower().encode("utf-8", "surrogatepass")))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        docs = [batch.column(k).take(pa.array(of, pa.int64())) for k in (0, 1)]
        columns = [*docs, pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in UNIT.split(", ")])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d1, d2, id, tie, text): the keys are never null, and equal only for equal id and text."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    named = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    return rows.select(F.xxhash64(named, "text").alias("d1"), F.xxhash64("text", named, F.lit(7)).alias("d2"), "id", F.xxhash64("text").alias("tie"), "text")


def _marked(rows: DataFrame) -> DataFrame:
    """The units whose normal form occurs more than once: document, offsets, digest, first (the rank that stays), own (their rank)."""
    found = store(rows.select(*DOC, "text").mapInArrow(_units, UNIT), "passages")
    # Tables, so that both sides of the joins are plain exchanges and a digest that stands in very many texts can be split.
    often = store(found.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "often")
    ranks = rows.select(*DOC, "id", "tie").dropDuplicates(DOC)
    again = store(found.join(often, "h1", "left_semi").join(ranks, DOC), "again")
    forget(found)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "tie", *DOC, "start")
    forget(often)
    first = store(again.groupBy(*DIGEST).agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    return again.withColumn("own", rank).join(first, DIGEST)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per removed unit: doc_id, start, stop, digest, and keep_doc_id and keep_start of the one that stays."""
    marked = _marked(_documents(docs, id_col, text_col))
    # Equal rows have equal units: as many rows as there are copies, of which the first one's units may stay.
    each = marked.groupBy(*DOC, "start", "stop", *DIGEST).agg(
        F.first("id").alias("id"), F.first("first").alias("first"), F.first("own").alias("own"), F.count("*").alias("copies")
    )
    gone = F.col("copies") - F.when(F.col("own") == F.col("first"), 1).otherwise(0)
    return each.where(gone > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), gone.cast("int")))).select(
        F.col("id").alias("doc_id"),
        "start",
        "stop",
        F.lower(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))).alias("digest"),
        F.col("first.id").alias("keep_doc_id"),
        F.col("first.start").alias("keep_start"),
    )


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> doc_id, spans that touch or overlap as one, and the text without them."""
    for batch in batches:
        runs, rest = [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["stop"]) for s in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            edges = [0, *(x for run in merged for x in run), len(text)]
            rest.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            runs.append([{"start": a, "stop": b} for a, b in merged])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rest, pa.string()), pa.array(runs, kind)], names=["doc_id", "text", "spans"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the text that stays, and the maximal removed spans, as offsets in the original text."""
    rows = _documents(docs, id_col, text_col)
    one = F.struct("start", "stop")
    each = _marked(rows).groupBy(*DOC, "start", "stop").agg(F.max(F.col("own") == F.col("first")).alias("stays"))
    # A document's own units only: no list is longer than its text.
    gone = each.groupBy(*DOC).agg(F.collect_list(F.when(~F.col("stays"), one)).alias("later"), F.collect_list(one).alias("every"))
    whole = rows.groupBy(*DOC).agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    none = F.array().cast(SPANS)
    judged = whole.join(gone, DOC, "left").select("id", "text", "copies", F.coalesce("later", none).alias("later"), F.coalesce("every", none).alias("every"))
    # Further copies of a row: every unit of theirs repeats the first copy's.
    more = F.when(F.col("copies") > 1, F.sequence(F.lit(2).cast("bigint"), "copies")).otherwise(F.array().cast("array<bigint>"))
    copies = judged.withColumn("copy", F.explode(F.concat(F.array(F.lit(1).cast("bigint")), more)))
    spans = F.when(F.col("copy") == 1, F.col("later")).otherwise(F.col("every"))
    found = copies.select(F.col("id").alias("doc_id"), "text", spans.alias("spans"))
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_rest, f"doc_id {kind}, text string, spans {SPANS}")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_removed (code points), n_spans, spans (start:stop, comma-joined) and kept_sha256."""
    rows = without_repeats(docs, id_col, text_col)
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return rows.select(
        "doc_id",
        length.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        listed.alias("spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )
