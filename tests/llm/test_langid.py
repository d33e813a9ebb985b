"""Language identification against plain sets of n-grams, and on held-out rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, score string, held_out int"
SYLLABLES = {"aa": "bri thor ley ston mar wick", "bb": "schul zeug heim licht wein bur", "cc": "при вет мир ный сло во"}


def documents(n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice("aaa aaa bb cc".split())[:2]
        words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.2:  # words of another language
            words += rng.choices(SYLLABLES["bb"].split(), k=3)
        rows.append((i, " ".join(words).title() + rng.choice(["", "!", " 12"]), lang if rng.random() < 0.8 else None))
    rows += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 34", "cc"), (n + 3, "ωωω ψψψ", None), (None, rows[0][1], "aa"), (None, rows[1][1], "bb"),
             rows[2], rows[2], (n + 4, "brithor " * 20_000, None)]
    return rows


def grams(text):
    raw = f"  {re.sub(r'[^a-zа-яωψ]+', ' ', (text or '').lower()).strip()}  ".encode()
    return [raw[i : i + 4] for i in range(len(raw) - 3)]


def brute(rows):
    """(doc_id, held_out, lang_pred, score) with exact sets in place of the Bloom filters."""
    out_of_training = [zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i, *_ in rows]
    counts, sizes = {}, Counter()
    for (_, text, lang), away in zip(rows, out_of_training, strict=True):
        if lang and not away:
            sizes[lang] += 1
            counts.setdefault(lang, Counter()).update(grams(text))
    rate = {lang: {g: k / c.total() for g, k in c.items()} for lang, c in counts.items()}
    best = Counter()
    for r in rate.values():
        best |= Counter(r)
    own = {lang: {g for g, x in r.items() if x >= langid.OWN_RATE * best[g]} for lang, r in rate.items()}
    order = sorted(own, key=lambda lang: (-sizes[lang], lang))
    found = []
    for (i, text, _), away in zip(rows, out_of_training, strict=True):
        if not re.search(r"[^\W\d_]", text or ""):
            found.append((i, away, "und", 0.0))
            continue
        all_grams = grams(text)
        share = {lang: sum(g in own[lang] for g in all_grams) / len(all_grams) for lang in order}
        top = max(order, key=lambda lang: (share[lang], -order.index(lang)))
        found.append((i, away, top, share[top]))
    return found


def test_predictions_equal_exact_sets(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score").collect()), key=lambda r: (repr(r[0]), r[3]))
    want = sorted(brute(rows), key=lambda r: (repr(r[0]), r[3]))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 0.01 for a, b in zip(got, want, strict=True))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    right, n = found.where("lang = lang_pred").count(), found.count()
    assert n > 100 and right >= 0.98 * n


def test_too_many_labels_are_refused(spark):
    docs = spark.range(700).selectExpr("id as doc_id", "'text' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="languages"):
        langid.identify(docs)
