"""Contexts without white space, and candidates of broad shapes."""

from __future__ import annotations

from tidemark.llm import pii


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}


def test_patterns_beside_an_entity_without_white_space(spark):
    seeds = [f"w{i} tel:+49 30 1234{i:03d}" for i in range(10)] + [f"q{i} z: e: no" for i in range(10)]
    got = spans(spark, [*seeds, "nun tel:0301 234 5678", "andere 0301 234 1111 zeile"])
    assert got[20] == "phone:8:21" and got[21] == ""


CARDS = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012888888881881", "6011 0000 0000 0004"]
#: By kind: words before and after it, a seed, unseen identifiers beside them, and one elsewhere.
BROAD = {
    "phone": ("mein fon=", "; danke", lambda i: f"+49 30 1234{i:03d}", ["0301234567", "030 12345678", "(030) 123-4567"], "0309876543"),
    "ip": ("am netz=", "| gruß", lambda i: f"10.0.0.{i}", ["fe80::1", "2001:db8::8a2e:370:7334", "::1", "1:2:3:4:5:6:7:8"], "fe80::2"),
    "card": ("zur kasse=", "! bald", lambda i: CARDS[i % 4], ["3782.822463.10005", "4222222222222", "4111/1111/1111/1111"], "30569309025904"),
    "email": ("an post=", "? dann", lambda i: f"a{i}@b.example", ["me at host dot example", "me{at}host.example"], "you at home dot example"),
}


def test_candidates_of_broad_shape(spark):
    texts, want = [], {}
    for kind, (before, after, seed, fresh, other) in BROAD.items():
        texts += [f"w{i}x {before} {seed(i)} {after} z{i}" for i in range(12)]
        for x in fresh:
            want[len(texts)] = f"{kind}:{5 + len(before)}:{5 + len(before) + len(x)}"
            texts.append(f"nun {before} {x} {after} so")
        want[len(texts)] = ""
        texts.append(f"die nummer war {other} und mehr")
    got = spans(spark, texts)
    assert {i: got[i] for i in want} == want


def test_totals_cut_every_text_once(spark):
    docs = spark.createDataFrame([("a",), ("a b",), ("a b a b",), (None,), ("",)], "text string")
    wanted = spark.createDataFrame([("a", 1), ("a b", 2), ("a b a", 3), ("b a b", 3), ("z", 1)], "word string, length int")
    totals = pii._totals(docs, "text", wanted)
    assert {r["word"]: r["total"] for r in totals.collect()} == {"a": 4, "a b": 3, "a b a": 1, "b a b": 1}
    assert totals._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
