"""BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the UTF-8 bytes cuts every text into chunks, so that equal
passages are cut alike wherever they stand. Texts are dealt to tasks by ranges
of their least chunk digest, then of a hash of their id: copies and texts that
share passages meet in a task, and a large group of them in a few; a sample of rows sets the bounds of the ranges. A worker encodes each chunk it has
not met before, word by word with a table of words, and looks up the others.

A chunk alone does not tell how its first and last word are encoded. A join is
therefore repaired: the text from the last white space of a chunk to the first
white space of the next is encoded anew, and if a chunk has none, the join grows
over it. No pre-token, no normalisation and no special token of the tokenizer
reaches across white space, so what stands between two such places has the same
ids alone as within the whole text; the tests hold this against the library on
whole texts. Only tokenizers that drop white space are accepted.

The lookup tables of a worker hold about ``CACHE_BYTES`` each and forget what has
not been met for longest. The tokenizer's file is named by a path that every executor can read.

Defined results: a null text counts as empty and has no ids; strings of special
tokens get the special ids, as the library has it; repeated rows are all
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rolling import STEP, rolling

WINDOW = 32
#: A cut after every 2 ** CUT_BITS bytes on average.
CUT_BITS = 9
CACHE_BYTES = 96 << 20
#: Rows a task in the sample behind the bounds of the ranges, and its seed.
SAMPLED, SEED = 100, 7
#: Stands between words that are encoded together; a word of its own for the tokenizer.
BAR = "|"
SPACE = re.compile(r"[ \n]")


def cuts(raw: bytes) -> list[int]:
    """Where the rolling hash of the last WINDOW bytes asks for a cut, at starts of characters only."""
    out: list[int] = []
    for at in range(0, len(raw) - WINDOW, STEP):
        part = np.frombuffer(raw, np.uint8)[at : at + STEP + WINDOW]
        asks = rolling(part, WINDOW)[:-1] >> np.uint64(64 - CUT_BITS) == 0
        out += (np.flatnonzero(asks & (part[WINDOW:] & 0xC0 != 0x80)) + at + WINDOW).tolist()
    return out


def slices(text: str) -> list[bytes]:
    raw = text.encode("utf-8")
    edges = [0, *cuts(raw), len(raw)]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def chunks(text: str) -> list[str]:
    return [raw.decode() for raw in slices(text)]


def pieces(text: str) -> list[tuple[bool, str]]:
    """The text as alternating joins (False) and insides of chunks (True), none of them empty."""
    out: list[tuple[bool, str]] = []
    join = ""
    for chunk in chunks(text):
        first = SPACE.search(chunk)
        last = max(chunk.rfind(" "), chunk.rfind("\n"))
        if first is None or last == first.start():
            join += chunk
            continue
        join += chunk[: first.start()]
        if join:
            out.append((False, join))
        out.append((True, chunk[first.start() : last]))
        join = chunk[last:]
    return [*out, (False, join)] if join else out


class Table:
    """A lookup table of bounded size that forgets what has not been met for longest."""

    def __init__(self, most: int) -> None:
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.most, self.size = most, 0

    def get(self, key: str) -> list[int] | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, ids: list[int]) -> None:
        self.young[key] = ids
        self.size += 160 + 2 * len(key) + 8 * len(ids)
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0


class Encoder:
    """Ids of whole texts: chunks from a lookup table, new chunks from their words, new words from the library."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            parts = json.load(f)
        if '"Removed"' not in json.dumps(parts["pre_tokenizer"]):
            raise ValueError("chunks can be joined only for tokenizers that drop white space")
        size = self.tokenizer.get_vocab_size()
        self.numbers = list(range(size))  # one object for each id
        self.names = [str(i) for i in self.numbers]
        self.plain = None if parts["decoder"] else [self.tokenizer.id_to_token(i) for i in self.numbers]
        bar = self.tokenizer.encode(BAR, add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self.chunks, self.words = Table(cache_bytes), Table(cache_bytes)

    def _encoded(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with its ids: in one call with a mark between them, or alone if the word holds the mark."""
        numbers, bar = self.numbers, self.bar
        alone = [w for w in words if not bar or BAR in w]
        together = [w for w in words if bar and BAR not in w]
        for word, new in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            yield word, [numbers[i] for i in new.ids]
        if together:
            ids: list[int] = []
            at = iter(together)
            for i in self.tokenizer.encode_batch_fast([f" {BAR} ".join([*together, ""])], add_special_tokens=False)[0].ids:
                if i == bar:
                    yield next(at), ids
                    ids = []
                else:
                    ids.append(numbers[i])

    def encode(self, text: str) -> list[int]:
        parts: list[tuple[bool, str, list[int] | None, list[str]]] = []
        found: dict[str, list[int]] = {}  # the words that are needed now
        fresh: list[str] = []
        for inside, piece in pieces(text):
            ids = self.chunks.get(piece) if inside else None
            words = [] if ids is not None else [w for w in piece.replace("\n", " ").split(" ") if w]
            for word in words:
                if word not in found:
                    known = self.words.get(word)
                    if known is None:
                        fresh.append(word)
                    found[word] = known
            parts.append((inside, piece, ids, words))
        for word, ids in self._encoded(fresh):
            found[word] = ids
            self.words.put(word, ids)
        out: list[int] = []
        for inside, piece, ids, words in parts:
            if ids is None:
                ids = [i for word in words for i in found[word]]
                if inside:
                    self.chunks.put(piece, ids)
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library's decode, whose tokens without a decoder are joined by spaces."""
        plain = self.plain
        return " ".join([plain[i] for i in ids]) if plain else self.tokenizer.decode(ids, skip_special_tokens=False)

    def listed(self, ids: list[int]) -> str:
        names = self.names
        return " ".join([names[i] for i in ids])


#: One for each worker process, by path: what a task has encoded serves the next.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    if (path, cache_bytes) not in _ENCODERS:
        _ENCODERS[path, cache_bytes] = Encoder(path, cache_bytes)
    return _ENCODERS[path, cache_bytes]


def _dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text), the texts that share chunks beside each other.

    Ranges of (least chunk digest, hash of the id), as repartitionByRange deals them, but with bounds from
    a sample of the rows: Spark's own would cut and hash every text once for the bounds and once for the
    deal. Bounds decide where a row is encoded, not whether; every row is dealt."""

    def least(text: str) -> int:
        import xxhash

        return min(map(xxhash.xxh64_intdigest, slices(text))) >> 1

    @F.pandas_udf("bigint")
    def digest(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(list(map(least, texts)), dtype="int64")

    @F.pandas_udf("int")
    def part(texts, spreads):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([bisect.bisect_left(bounds, (least(t), s)) for t, s in zip(texts, spreads, strict=True)], dtype="int32")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("doc_id")
    rows = docs.count()
    sample = docs.sample(min(1.0, SAMPLED * parts / max(rows, 1)), SEED).select(digest("text"), spread)
    # Within one digest rows are ordered by a hash, so that ranges cut a large group of copies.
    found = sorted(tuple(r) for r in sample.collect())
    bounds = [found[len(found) * i // parts] for i in range(1, parts)] if found else []
    return docs.withColumn("__part", part("text", spread)).repartitionById(parts, "__part")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int) and decoded (the text that the ids give)."""
    return _encoded(docs, path, id_col, text_col, digests=False)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """encode() with digests in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``cache_bytes`` bounds a worker's tables; smaller ones leave memory to others and encode more words again."""
    return _encoded(docs, path, id_col, text_col, digests=True, cache_bytes=cache_bytes)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, digests: bool, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, cache_bytes)
        for batch in batches:
            found: list[tuple] = []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                whole = encoder.decode(ids)
                if digests:
                    shas = (hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (encoder.listed(ids), whole))
                    found.append((len(ids), *shas))
                else:
                    found.append((ids, whole))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _dealt(rows).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")
