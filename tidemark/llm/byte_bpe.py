"""Byte-level BPE encoding and decoding by a table of last tokens.

For every prefix of a piece of text the last token of the prefix's encoding is
stored; it is unique. It is the one token that ends the prefix and *fits* the
last token of what stands before it: a pair of tokens fits if BPE leaves the
pair as it is when it starts from its bytes. So one pass from left to right
encodes a piece, and its ids are read from the end. As a prefix's entry depends
on shorter prefixes only, ``Prefixes.append`` extends a table without looking
back, and ``Prefixes.replace`` fills it anew from an edit on, until as many
entries as the longest token has bytes agree with the old ones; the rest is
taken over. ``revise`` does the same for whole texts, by their pieces.

A text is cut into pieces by a pattern, each of which is encoded by itself; a
piece that is a token is that token. Encoding needs no shuffle: every task keeps
a table of the pieces it has met, of about ``TABLE_BYTES``, and long texts are
cut in slices. The pattern is matched by ``regex``, whose character classes
may be newer than those of ``tiktoken``; characters that only the former
calls letters or numbers are taken out of the classes.

Defined results: a null text counts as empty, has no ids and decodes to the
empty text; strings of special tokens are ordinary text; repeated rows and rows
without an id are all returned; an empty table gives an empty result; other columns are
ignored. The files are named by a path that every executor can read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_BYTES = 384 << 20
#: A piece takes over the entries of its first bytes from an earlier piece that begins alike.
STEMS = (8, 5)
#: Characters of a long text that are cut into pieces at once.
SLICE = 1 << 20
#: A match of the patterns in use depends on so many characters behind its end at most ('re, then what follows).
AHEAD = 2


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks of byte tokens, and which pairs of tokens fit."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        #: By its last three bytes, how long a token of three bytes or more can be, shortest first.
        self.sizes = {end: tuple(sorted(found)) for end, found in ends.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens that BPE merges last to make this one; None for a byte or a token that no merge makes."""
        if rank not in self._halves:
            ranks = self.ranks
            parts = [bytes([b]) for b in self.tokens[rank]]
            while len(parts) > 2:
                merged = [ranks.get(a + b, len(ranks) + 1) for a, b in pairwise(parts)]
                best = min(merged)
                if best > len(ranks):
                    break
                at = merged.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            pair = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
            if pair and len(self.tokens[rank]) > 2 and max(pair) >= rank:
                raise ValueError(f"token {rank} has a lower rank than its parts")
            self._halves[rank] = pair
        return self._halves[rank]

    def made(self, rank: int) -> bool:
        """Whether BPE gives this token for its bytes."""
        return len(self.tokens[rank]) == 1 or self.halves(rank) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves this pair apart.

        Merges are undone from the last to the first, so that the two tokens at
        the border are seen as they were at every earlier time. Had they a merge
        that comes before the one just undone, BPE would have taken it.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        tokens, ranks = self.tokens, self.ranks
        a, b, before = left, right, len(ranks) + 1
        fit = self.made(right)
        while fit:
            fit = ranks.get(tokens[a] + tokens[b], len(ranks) + 1) >= before
            born_a, born_b = (t if len(tokens[t]) > 1 else -1 for t in (a, b))
            if born_a == born_b == -1:
                break
            if born_a > born_b:  # a was made last
                a, before = self.halves(a)[1], born_a
            else:  # of equal merges the left one comes first, so that b is the later
                b, before = self.halves(b)[0], born_b + 1
        if len(self._fits) > 4_000_000:
            self._fits.clear()
        self._fits[left, right] = fit
        return fit


class Prefixes:
    """The last token of every prefix of a piece."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b"", last: tuple[int, ...] = ()) -> None:
        """``last`` are the entries of the first bytes, where they are known."""
        self.vocabulary, self.raw = vocabulary, raw
        self.last = [*last]
        self._fill(raw, self.last, len(raw))

    def append(self, more: bytes) -> None:
        """Extend the piece; no earlier entry changes."""
        self.raw += more
        self._fill(self.raw, self.last, len(self.raw))

    def _fill(self, raw: bytes, last: list[int], stop: int) -> None:
        """Entries of the prefixes behind those in ``last``, up to the length ``stop``."""
        v = self.vocabulary
        sizes, rank, known, fits = v.sizes.get, v.ranks.get, v._fits.get, v.fits
        for end in range(len(last) + 1, stop + 1):
            token = None
            for size in sizes(raw[end - 3 : end], ()) if end > 2 else ():
                if size >= end:
                    break
                one = rank(raw[end - size : end])
                if one is not None:
                    before = last[end - size - 1]
                    fit = known((before, one))
                    if fit if fit is not None else fits(before, one):
                        token = one
                        break
            if token is None:  # the whole prefix, two bytes or one
                token = rank(raw[:end])
                if token is None or not v.made(token):
                    token = rank(raw[end - 2 : end]) if end > 2 else None
                    if token is None or not fits(last[end - 3], token):
                        token = rank(raw[end - 1 : end])
                        if token is None:
                            raise ValueError("the vocabulary lacks single bytes")
            last.append(token)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of raw[start:stop]; returns how many entries were made anew."""
        raw = self.raw[:start] + new + self.raw[stop:]
        shift = len(raw) - len(self.raw)
        last = self.last[:start]
        same = 0
        for end in range(start + 1, len(raw) + 1):
            self._fill(raw, last, end)
            token = last[-1]
            old = end - shift
            # Entries of the old table are comparable where all bytes back to the longest token's are behind the edit.
            same = same + 1 if old > stop and self.last[old - 1] == token else 0
            if same >= self.vocabulary.longest:
                made = end - start
                self.raw, self.last = raw, last + self.last[old:]
                return made
        self.raw, self.last = raw, last
        return len(raw) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.raw)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces(dict):
    """The ids of pieces as packed 32-bit integers; encodes what it does not have.

    It keeps two generations of about half of ``TABLE_BYTES`` each: when the
    younger is full, what has not been met since the last time is forgotten."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.bytes = vocabulary, 0
        self.old: dict[str, bytes] = {}
        self.stems: dict[bytes, tuple[int, ...]] = {}

    def _ids(self, raw: bytes) -> list[int]:
        long, short = STEMS
        if len(raw) <= short:
            return Prefixes(self.vocabulary, raw).ids()
        known = self.stems.get(raw[:long]) or self.stems.get(raw[:short], ())
        table = Prefixes(self.vocabulary, raw, known)
        for size in STEMS:
            if len(known) < size < len(raw):
                self.stems[raw[:size]] = tuple(table.last[:size])
                self.bytes += 130 + 9 * size
        return table.ids()

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.vocabulary.ranks.get(raw)
            packed = pack(self._ids(raw)) if whole is None else pack([whole])
        self.bytes += 160 + 2 * len(piece) + len(packed)
        if self.bytes > TABLE_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.stems.clear()
            self.bytes = 0
        self[piece] = packed
        return packed


def _newer(kind: str) -> str:
    """The characters that ``regex`` has in a class and ``tiktoken`` has not, as ranges within brackets."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    library = tiktoken.Encoding(f"of {kind}", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    known = set(library.decode(library.encode_ordinary(every)))
    ranges: list[list[int]] = []
    for c in map(ord, regex.findall(kind, every)):
        if chr(c) not in known:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Encoder:
    """Cuts texts into pieces and gives their ids."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.vocabulary = Vocabulary(read_ranks(path))
        self.pieces = Pieces(self.vocabulary)
        self.plain = regex.compile(pattern)
        newer = {kind: _newer(kind) for kind in (r"\p{L}", r"\p{N}", r"\s") if kind in pattern}
        self.newer = regex.compile(f"[{''.join(newer.values())}]") if any(newer.values()) else None
        # Most texts have no character beyond the least of them, which is quickly seen.
        least = min((found[: found.index("-")] for found in newer.values() if found), default="")
        self.beyond = regex.compile(f"[{least}-\\U0010ffff]") if least else None
        strict = pattern
        for kind, ranges in newer.items():
            if ranges:
                strict = strict.replace(kind, f"[{kind}--[{ranges}]]")
        self.strict = regex.compile("(?V1)" + strict) if self.newer else self.plain

    def cut(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, slice by slice."""
        odd = self.newer is not None and not text.isascii() and self.beyond.search(text) and self.newer.search(text)
        find = (self.strict if odd else self.plain).findall
        at, step = 0, SLICE
        while at < len(text):
            part = text[at : at + step]
            found = find(part)
            if at + step < len(text):
                size = len(part)
                while found and size > len(part) - AHEAD:
                    size -= len(found.pop())
                if not found:
                    step *= 2
                    continue
            else:
                size = len(part)
            yield found
            at, step = at + size, SLICE

    def encode(self, text: str) -> bytes:
        """The ids as packed little-endian 32-bit integers."""
        get = self.pieces.__getitem__
        return b"".join([b"".join(map(get, found)) for found in self.cut(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def revise(self, old: str, ids: list[int], new: str) -> tuple[list[int], int]:
        """The ids of ``new`` from those of ``old``, and how many characters were encoded for them.

        Pieces before the first difference stay, but for those that depend on it;
        after the last one, cutting goes on until it meets a border of the old pieces.
        """
        most = min(len(old), len(new))
        head = _common(old[:most], new[:most])
        tail = _common(old[head:][::-1][: most - head], new[head:][::-1][: most - head])
        starts, borders, at = 0, {}, 0
        for part in self.cut(old):
            for piece in part:
                if at + len(piece) <= head - AHEAD:
                    starts = at + len(piece)
                borders[at] = None
                at += len(piece)
        borders[at] = None
        shift = len(new) - len(old)
        made: list[bytes] = []
        stop, done = starts, False
        for part in self.cut(new[starts:]):
            for piece in part:
                if stop >= len(new) - tail and stop - shift in borders:
                    done = True
                    break
                made.append(self.pieces[piece])
                stop += len(piece)
            if done:
                break
        ends = np.cumsum([len(self.vocabulary.tokens[i]) for i in ids], dtype=np.int64) if ids else np.zeros(0, np.int64)
        first = int(np.searchsorted(ends, len(old[:starts].encode("utf-8", "surrogatepass")), "right"))
        rest = int(np.searchsorted(ends, len(old[: stop - shift].encode("utf-8", "surrogatepass")), "right"))
        return [*ids[:first], *np.frombuffer(b"".join(made), "<u4").tolist(), *ids[rest:]], stop - starts


def _common(a: str, b: str) -> int:
    """How many characters two texts of one length share at their start."""
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


#: One for each worker process, by path and pattern: what a task has encoded serves the next.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def _mapped(rows: DataFrame, make, types: dict[str, pa.DataType], schema: str) -> DataFrame:  # noqa: ANN001
    """One row per row: its first column as doc_id, and what ``make`` gives for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [make(*(x.as_py() for x in row)) for row in zip(*batch.columns[1:], strict=True)]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *types])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def _rows(docs: DataFrame, id_col: str, *columns) -> DataFrame:  # noqa: ANN002
    return docs.select(F.col(id_col).alias("doc_id"), *columns)


def _text(column: str, name: str = "text"):  # noqa: ANN202
    return F.coalesce(F.col(column), F.lit("")).alias(name)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids (array of int)."""

    def make(text: str) -> tuple:
        return (np.frombuffer(encoder(path, pattern).encode(text), "<u4"),)

    return _mapped(_rows(docs, id_col, _text(text_col)), make, {"ids": pa.list_(pa.int32())}, "ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary): the bytes that the ids give; null ids give none."""

    def make(ids: list[int] | None) -> tuple:
        return (encoder(path, pattern).decode(np.array(ids or [], "<u4").tobytes()),)

    return _mapped(_rows(encoded, id_col, F.col(ids_col).alias("ids")), make, {"decoded": pa.binary()}, "decoded binary")


def re_encode(
    encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", new_col: str = "new_text"
) -> DataFrame:
    """doc_id, ids of ``new_col``, and n_encoded: how many characters had to be encoded, near the edits of ``text_col``.

    ``ids_col`` holds the ids of ``text_col``; null ids are those of the empty text.
    """

    def make(text: str, ids: list[int] | None, new: str) -> tuple:
        return encoder(path, pattern).revise(text if ids else "", ids or [], new)

    rows = _rows(encoded, id_col, _text(text_col), F.col(ids_col).alias("ids"), _text(new_col, "new"))
    return _mapped(rows, make, {"ids": pa.list_(pa.int32()), "n_encoded": pa.int64()}, "ids array<int>, n_encoded bigint")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 (of the decoded bytes)."""

    def make(text: str) -> tuple:
        own = encoder(path, pattern)
        packed = own.encode(text)
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.decode(packed)).hexdigest()

    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _mapped(_rows(docs, id_col, _text(text_col)), make, types, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
