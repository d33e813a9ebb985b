"""Repeated passages on all levels of units."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash

from tidemark.llm import passage_dedup
from tidemark.llm.queries import queries

SCHEMA = "doc_id bigint, text string"
PASSAGE = "The first shared sentence has quite a few words in it. No. The last shared sentence of them also has many words."


def removed(spark, texts):
    df = spark.createDataFrame(texts, SCHEMA).repartition(3)
    found = passage_dedup.repeats(df).collect()
    by = dict(texts)
    return {(r["doc_id"], by[r["doc_id"]][r["start"] : r["stop"]], r["keep_doc_id"]) for r in found}


def test_short_lines_and_passages_inside_lines(spark):
    texts = [
        (1, "Own words begin here and go on for long enough.\nAll rights reserved\nend of one"),
        (2, "something else\n  all  RIGHTS reserved \n\nend of two"),
        (3, f"é A text of its own stands before the passage here. {PASSAGE} Then it ends in its own way, as no other does."),
        (4, f"Quite another beginning, unlike that of any other text. {PASSAGE} And quite another end that stands nowhere else."),
        (5, None),
        (6, ""),
    ]
    got = removed(spark, texts)
    assert (2, "all  RIGHTS reserved", 1) in got
    assert (4, "The first shared sentence has quite a few words in it.", 3) in got
    assert (4, "No. The last shared sentence of them also has many words.", 3) in got
    assert not any(i in (1, 3, 5, 6) for i, _, _ in got) and not any("nowhere else" in t or "Quite" in t for _, t, _ in got)


def test_paragraphs_and_repeated_or_missing_ids(spark):
    texts = [(7, "a b\nc d\n \nx"), (7, "a  b c\nd"), (None, "only line"), (None, "only line"), (9, "y\n\nonly line")]
    found = passage_dedup.repeats(spark.createDataFrame(texts, SCHEMA)).collect()
    assert sorted((r["doc_id"] is None, r["keep_doc_id"], r["start"]) for r in found) == [(False, 7, 0), (True, 9, 0), (True, 9, 0)]
    assert "op4_line_dedup" in queries()


def test_no_unit_is_left_out():
    text = "One. Two!\n\nthree four\nA. B. C d e f g h i j. K."
    whole = {text[a:b] for a, b in passage_dedup.spans(text)}
    assert {"One. Two!", "three four", "A. B. C d e f g h i j.", "C d e f g h i j.", "C d e f g h i j. K."} <= whole


def brute(rows):
    """(doc_id, n_removed, n_spans, spans, kept_sha256) of every row, from a dictionary of all units."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, tie(rows[k][1]), k))
    first, out = {}, []
    for k in order:
        text = rows[k][1] or ""
        gone = set()
        for a, b in sorted(passage_dedup.spans(text)):
            form = re.sub(r"[\x20\x09-\x0D]+", " ", text[a:b]).lower()
            if first.setdefault(form, (k, a)) != (k, a):
                gone.update(range(a, b))
        runs = [(p, next(q for q in range(p, len(text) + 1) if q not in gone)) for p in sorted(gone) if p - 1 not in gone]
        kept = "".join(c for i, c in enumerate(text) if i not in gone)
        out.append((rows[k][0], len(gone), len(runs), ",".join(f"{a}:{b}" for a, b in runs), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def tie(text):
    """Spark's xxhash64 of a text, by which rows of one id are ranked."""
    found = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return found - (1 << 64) if found >> 63 else found


def test_documents_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma.", "delta", "Épsilon!", "zeta", "eta?", "x", "y"]

    def line():
        return " ".join(rng.choices(words, k=rng.choice([1, 2, 9, 12])))

    shared = [line() for _ in range(12)]
    rows = [(i % 70, rng.choice(["\n", "\n\n", " ", "\n \n"]).join(rng.choice(shared) if rng.random() < 0.3 else line() for _ in range(rng.randrange(7))))
            for i in range(90)]
    rows += [(None, None), (None, rows[3][1]), (None, rows[3][1]), (500, None), (501, ""), (502, " \n\t"), rows[5], rows[5], rows[6],
             (503, "a long line of words that go on " * 3000), (504, "a long line of words that go on " * 3000 + ".")]
    docs = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], SCHEMA + ", d1 int, spans string, copies int").repartition(4)
    found = passage_dedup.documents(docs)
    assert found.columns == ["doc_id", "n_removed", "n_spans", "spans", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)
    assert passage_dedup.documents(docs.limit(0)).collect() == [] and passage_dedup.repeats(docs.limit(0)).collect() == []


def test_one_line_in_most_texts(spark):
    rows = [(i, f"own words of text number {i}\nthe very same line") for i in range(600)]
    found = passage_dedup.documents(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert {r.doc_id for r in found if r.n_removed} == set(range(1, 600))
    assert all(r.spans.count(":") == r.n_spans for r in found)
