"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, pos int, score string, n_words int"


def features(text, longest):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1):
    buckets = [[zlib.crc32(f.encode()) % 10000 for f in features(t, longest)[1]] for _, t in docs]
    own, wanted = Counter(b for x in buckets for b in x), Counter(zlib.crc32(f.encode()) % 10000 for t in target for f in features(t, longest)[1])
    s, t = float(own.total() + 10000), float(wanted.total() + 10000)
    rows = []
    for (i, text), found in zip(docs, buckets, strict=True):
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1.0) * s / ((own[b] + 1.0) * t))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(features(text, 1)[0])])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(able[: 10 * len(able) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 16)
    monkeypatch.setattr(resampling, "DIGIT_BITS", 4)


def tables(spark, docs, target):
    rows = spark.createDataFrame([(*d, 1, "s", 2) for d in docs], SCHEMA).repartition(5)
    return rows, spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize("longest", [1, 2])
def test_rows(spark, small, longest):
    rng = random.Random(3)
    words = ["Alpha", "beta9", "naïve", "ÉTÉ", "İx", "don't", "a_b", "中文", "x"]
    docs = [(i * 7 - 50, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 40])))) for i in range(230)]
    docs += [(None, "null id " * 15), (None, None), (3, None), (4, ""), (5, "word " * 30_000), docs[7], docs[7], (docs[9][0], "other " * 25)]
    target = ["alpha beta9 alpha", None, "", "naïve x"]
    found = resampling.resample(*tables(spark, docs, target), longest=longest)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, target, longest)


def test_many_equal_scores_are_ranked_by_id(spark, small):
    rows = spark.createDataFrame([(7, i % 50 if i % 9 else None) for i in range(600)] + [(8, -(2**40))], "score bigint, doc_id bigint")
    order = [tuple(r) for r in resampling.ranked(rows, [("score", True), ("doc_id", False)]).orderBy("pos").select("pos", "score", "doc_id").collect()]
    assert [r[0] for r in order] == list(range(601))
    want = sorted(((r.score, r.doc_id) for r in rows.collect()), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert [r[1:] for r in order] == want


def test_empty_tables(spark):
    docs, target = tables(spark, [], ["x"])
    assert resampling.resample(docs, target).collect() == []
    docs, target = tables(spark, [(1, "a " * 20)], [])
    assert sorted(map(tuple, resampling.resample(docs, target).collect()), key=repr) == brute([(1, "a " * 20)], [])
