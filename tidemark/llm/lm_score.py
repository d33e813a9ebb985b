"""Scores of whole texts under a word model, by a weighted backoff automaton.

The model is learned from the training texts: token counts give the base
distribution p0(w) = (c(w) + 1) / (N + V + 1), and bigram counts are smoothed
towards it with MASS units of prior mass,

    p(w | h) = (c(h, w) + MASS * p0(w)) / (c(h) + MASS).

As an automaton: the tokens seen in training are the states, a seen bigram is an
arc with the weight above, and every state has a failure arc of weight
MASS / (c(h) + MASS) to the empty state, whose arcs are p0 and whose arc for
unknown tokens is p0 with a count of zero. A text is read once from left to
right; the state is the token read last, and the logarithms of the arcs taken
are summed up. For each h the probabilities of all tokens, the unknown one
included, sum to one.

The automaton grows with the corpus, so it is never broadcast. Texts are dealt
into blocks of about BLOCK_BYTES. A block sends the ids of its n-grams, sorted,
each once and with its count in the block's training texts, to the buckets of
the id space; a bucket adds up the counts of all blocks and answers each block
with the totals in the order of its ids. With these a block holds exactly the states and arcs
its texts can take, and reads them through. The rows that move are packed arrays
of n-grams, pre-aggregated by block; a frequent n-gram is one number for a block.

Tokens and bigrams are known by 64-bit hashes (XXH64 of the bytes; a mix of two
of these).

Defined results: a null text counts as empty and has one token, its end; with no
training text at all every token has probability 1 / (V + 1) with V = 0; repeated
rows are all returned; a null id counts as the empty text where rows are dealt by
id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import remainder
from tidemark.llm.simhash import LOWER

MASS = 50.0
BLOCK_BYTES = 16 << 20
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")
REQUEST = "block int, bucket int, ids binary, counts binary"
ANSWER = "block int, bucket int, counts binary"


def _pack(values: np.ndarray) -> bytes:
    """A 64-bit array as compressed planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    return _pack(np.diff(ids, prepend=np.uint64(0)))


def _unpack_ids(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def tokens(text: str | None) -> np.ndarray:
    """Ids of a text's tokens: its words and its end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    out = np.full(len(words) + 1, END, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return out


def _read(texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, previous ids, first positions) of many texts, one after the other."""
    found = [tokens(t) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    first = np.cumsum(sizes) - sizes
    ids = np.concatenate(found)
    before = np.roll(ids, 1)
    before[first] = START
    return ids, before, first


def _bigrams(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ ((ids << np.uint64(29)) | (ids >> np.uint64(35)))
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _counted(ids: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(ids, return_inverse=True)
    return unique, np.bincount(inverse, weights, len(unique)).astype(np.int64)


def _bucketed(block: int, ids: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted ids and their counts, cut at equal steps of the id space; empty pieces left out."""
    edges = [(1 << 64) * b // buckets for b in range(1, buckets)]
    cut = [0, *np.searchsorted(ids, np.array(edges, np.uint64)).tolist(), len(ids)]
    full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * len(full), pa.int32()),
            pa.array(full, pa.int32()),
            pa.array([_pack_ids(ids[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
            pa.array([_pack(counts[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
        ],
        names=["block", "bucket", "ids", "counts"],
    )


def _added(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The requests of a bucket: ids of each, and all ids with their totals."""
    each = [_unpack_ids(x.as_py()) for x in table["ids"]]
    counts = [_unpack(x.as_py()) for x in table["counts"]]
    ids, totals = _counted(np.concatenate(each), np.concatenate(counts).astype(np.float64))
    return each, ids, totals


def vocabulary(texts: DataFrame, buckets: int) -> tuple[int, int]:
    """(N, V): tokens and distinct tokens of ``text`` in all rows."""

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, _, _ = _read(t.as_py() for t in batch.column(0))
                yield _bucketed(0, *_counted(ids), buckets)

    def total(table: pa.Table) -> pa.Table:
        _, ids, totals = _added(table)
        return pa.table({"n": pa.array([int(totals.sum())]), "v": pa.array([len(ids)])})

    rows = texts.select("text").mapInArrow(request, REQUEST).groupBy("bucket").applyInArrow(total, "n bigint, v bigint")
    row = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def automaton(
    token: np.ndarray, state: np.ndarray, arc: np.ndarray, total: int, types: int, mass: float = MASS
) -> tuple[np.ndarray, np.ndarray]:
    """(root, taken): the weights met in one pass from left to right, from the counts of each token, state and arc.

    ``root`` is the arc of the empty state for the token. ``taken`` is the state's own arc for the token where training
    has it; elsewhere the state's failure arc leads to the empty state without reading, and its arc follows. The empty
    state (a count of zero, behind an unknown token) has no failure arc. Weights are logarithms to base 10.
    """
    base = (token + 1) / (total + types + 1)
    taken = base.copy()
    fails = np.flatnonzero((arc == 0) & (state > 0))
    taken[fails] *= mass / (state[fails] + mass)
    own = np.flatnonzero(arc > 0)
    taken[own] = (arc[own] + mass * base[own]) / (state[own] + mass)
    return np.log10(base), np.log10(taken)


def score(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", mass: float = MASS
) -> DataFrame:
    """One row per input row: doc_id, training, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` says of a row whether the model learns from it.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("bigint"))).first()[0] or 0
    n_blocks = int(size // BLOCK_BYTES) + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), training.alias("training"))
    total, types = vocabulary(rows.where("training"), n_blocks)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block")

    def request(table: pa.Table) -> pa.Table:
        ids, before, first = _read(t.as_py() for t in table["text"])
        learn = np.array(table["training"].to_pylist(), np.float64)
        learn = np.repeat(learn, np.diff(first, append=len(ids)))
        both = np.concatenate([ids, _bigrams(before, ids)])
        found = _counted(both, np.concatenate([learn, learn]))
        return pa.Table.from_batches([_bucketed(table["block"][0].as_py(), *found, n_blocks)])

    def answer(table: pa.Table) -> pa.Table:
        each, ids, totals = _added(table)
        packed = [_pack(totals[np.searchsorted(ids, one)]) for one in each]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "counts": pa.array(packed, pa.binary())})

    def traverse(key: tuple, texts: pa.Table, model: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return empty
        ids, before, first = _read(t.as_py() for t in texts["text"])
        order = np.argsort(model["bucket"].to_numpy())
        arcs_taken = _bigrams(before, ids)
        names = np.unique(np.concatenate([ids, arcs_taken]))  # the block's request, in whose order the answers come
        counts = np.concatenate([_unpack(model["counts"][int(k)].as_py()) for k in order]).astype(np.float64)
        count = lambda wanted: counts[np.searchsorted(names, wanted)]
        known = count(ids)
        state = np.roll(known, 1)  # of the token read last; zero for the empty state
        state[first] = count(np.array([END], np.uint64))[0]  # as many texts begin as end
        base, arcs = automaton(known, state, count(arcs_taken), total, types, mass)
        add = lambda x: np.add.reduceat(x, first)
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "training": texts["training"],
                "n_tokens": pa.array(np.diff(first, append=len(ids))),
                "n_known": pa.array(add((known > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(first), total, np.int64)),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(arcs)),
            }
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, training boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    empty = pa.table({n: pa.array([]) for n in ("doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
    answers = dealt.groupBy("block").applyInArrow(request, REQUEST).groupBy("bucket").applyInArrow(answer, ANSWER)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(traverse, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 7) == 2


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() of all rows, learned from those that are not held out: doc_id, held_out and the figures."""
    found = score(docs, ~held_out(id_col), id_col, text_col)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
