"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard in memory.

Suffixes are classified as larger or smaller than their right neighbour. The
substrings between leftmost-smaller positions are sorted by one round of
inducing, named, and the string of names is sorted by recursion; a second round
induces the whole array. With a small alphabet a round goes bucket by bucket in
whole arrays; with the large alphabets of the recursion it goes entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
SMALL = 300


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next; the last position counts as smaller."""
    step = np.sign(np.diff(s))
    where = np.where(step != 0, np.arange(len(step)), len(s))
    upcoming = np.minimum.accumulate(where[::-1])[::-1]
    out = np.ones(len(s), bool)
    out[:-1] = step[np.minimum(upcoming, len(step) - 1)] > 0
    return out


def _spread(array: np.ndarray, at: np.ndarray, chars: np.ndarray, values: np.ndarray, sigma: int, down: bool) -> None:
    """Put values into their characters' buckets in the order given, from ``at`` upwards or downwards."""
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    count = np.bincount(chars, minlength=sigma)
    rank = np.arange(len(chars)) - (np.cumsum(count) - count)[chars]
    array[at[chars] - rank if down else at[chars] + rank] = values[order]
    at += -count if down else count


def _by_bucket(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    size = np.bincount(s, minlength=sigma)
    ends = np.cumsum(size)
    starts = ends - size
    larger_n = np.bincount(s[~smaller], minlength=sigma)
    array = np.full(len(s), -1, np.int64)
    array[0] = len(s) - 1  # the end of the string, which no suffix induces
    given = s[lms]
    low = np.searchsorted(given, np.arange(sigma))  # lms comes in the order of first characters
    high = np.searchsorted(given, np.arange(sigma), side="right")
    short = s.astype(np.uint16)
    head = starts.copy()
    for c in range(sigma):
        at = starts[c]
        while True:
            batch = array[at : head[c]]
            at += len(batch)
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _spread(array, head, short[before], before, sigma, False)
            if at == head[c]:
                break
        before = lms[low[c] : high[c]]
        before = before[before > 0] - 1
        if len(before):
            _spread(array, head, short[before], before, sigma, False)
    tail = ends - 1
    for c in range(sigma - 1, -1, -1):
        at = ends[c] - 1
        while at > tail[c]:
            batch = array[tail[c] + 1 : at + 1][::-1]
            at = tail[c]
            before = batch[batch > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _spread(array, tail, short[before], before, sigma, True)
        batch = array[starts[c] : starts[c] + larger_n[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _spread(array, tail, short[before], before, sigma, True)
    return array


def _by_entry(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    size = np.bincount(s, minlength=sigma)
    ends = np.cumsum(size)
    head, tail = (ends - size).tolist(), (ends - 1).tolist()
    chars, small = s.tolist(), smaller.tolist()
    array = [-1] * len(chars)
    last = tail.copy()
    for i in lms[::-1].tolist():
        c = chars[i]
        array[last[c]] = i
        last[c] -= 1
    for k in range(len(chars)):
        i = array[k] - 1
        if i >= 0 and not small[i]:
            c = chars[i]
            array[head[c]] = i
            head[c] += 1
    for k in range(len(chars) - 1, -1, -1):
        i = array[k] - 1
        if i >= 0 and small[i]:
            c = chars[i]
            array[tail[c]] = i
            tail[c] -= 1
    return np.array(array, np.int64)


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the substrings that begin at ``lms``, given their order: equal for equal substrings."""
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms)
    a, b = ordered[:-1], ordered[1:]
    differs = length[a] != length[b]
    active = np.flatnonzero(~differs & (length[b] > 0))
    k = 0
    while len(active):
        equal = s[a[active] + k] == s[b[active] + k]
        differs[active[~equal]] = True
        active = active[equal]
        active = active[length[b[active]] > k]
        k += 1
    differs |= length[b] == 0  # the end of the string equals nothing
    name = np.zeros(len(s), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(differs)])
    return name[lms], int(differs.sum()) + 1


def _sort(s: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of s, whose last character is 0 and occurs nowhere else."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    smaller = _smaller(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _by_bucket if sigma <= SMALL else _by_entry
    rough = induce(s, smaller, lms[np.argsort(s[lms], kind="stable")], sigma)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = rough[rough >= 0]
    ordered = ordered[is_lms[ordered]]
    names, n = _names(s, lms, ordered)
    if n < len(lms):
        ordered = lms[_sort(names, n)]
    return induce(s, smaller, ordered, sigma)


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of a byte array in the order of the suffixes."""
    return _sort(np.concatenate([raw.astype(np.int64) + 1, [0]]), 257)[1:]


def permuted_prefixes(raw: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lcp, before): by position, the suffix before it in the array (-1 for the first) and their common prefix.

    A position that follows the same byte as the suffix before it does has the
    prefix of its left neighbour less one; only the others are compared.
    """
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    follows = np.zeros(n, bool)
    inner = np.flatnonzero((before > 0) & (at > 0))
    follows[inner] = raw[inner - 1] == raw[before[inner] - 1]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 1]
    words = np.ascontiguousarray(words).view("<u8").ravel()
    lcp = np.zeros(n, np.int64)
    active = np.flatnonzero(~follows & (before >= 0))
    while len(active):
        a, b = active + lcp[active], before[active] + lcp[active]
        fit = np.maximum(a, b) + 8 <= n
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        same = np.where(x == 0, 8, 0)
        odd = np.flatnonzero(x)
        low = (x[odd] & (~x[odd] + np.uint64(1))).astype(np.float64)
        same[odd] = np.log2(low).astype(np.int64) // 8
        same = np.minimum(same, n - np.maximum(a, b))
        lcp[active] += same
        active = active[(same == 8) & fit]
    source = np.maximum.accumulate(np.where(follows, -1, at))
    return np.maximum(lcp[source] - (at - source), 0), before
