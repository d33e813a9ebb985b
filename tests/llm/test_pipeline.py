"""run() of the corpus pipeline against a plain Python account of its five stages."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import langid
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _documents():
    rng = np.random.default_rng(11)
    vocabulary = {"en": ["the", "house", "water", "garden", "with"], "de": ["der", "schnee", "wasser", "garten", "und"]}
    for lang, syllables in (("en", "bring thor wick ley ston mar"), ("de", "schul zeug heim burg licht wein")):
        parts = syllables.split()
        vocabulary[lang] += [a + b for a in parts for b in parts]
    rows = []
    for i in range(48):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choice(vocabulary[lang], 40 + 9 * i))
        rows.append([i, text, lang if i % 5 else None, ("web", "books", None, "code")[i % 4 if i % 3 else 0], None])
    long = rows[40][1]
    near = (f"{long} {w} {v}" for w in vocabulary["en"] for v in vocabulary["en"])
    close = next(t for t in near if 0 < (fingerprint(t) ^ fingerprint(long)).bit_count() <= 2)
    rows += [[60, close, None, "web", 7], [61, rows[3][1].replace(" ", "  "), "de", "books", None], [62, rows[5][1], None, None, None]]
    rows += [[63, rows[5][1], None, "code", None], [70, None, "en", "web", None], [71, "", None, None, 0], [72, "12 34", "de", "web", None]]
    return [tuple(r) for r in [*rows, (73, "привет мир " * 9, None, "books", None), (74, "ok", None, None, None)]]


def _grams(text):
    raw = f"  {re.sub(r'[^a-zäöüßа-я]+', ' ', text.lower()).strip()}  ".encode()
    return [raw[i : i + 4] for i in range(len(raw) - 3)]


def identified(docs):
    counts = defaultdict(Counter)
    for i, text, lang, *_ in docs:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2 and text:
            counts[lang].update(_grams(text))
    rate = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    best = Counter()
    for r in rate.values():
        best |= Counter(r)
    own = [{g for g, x in r.items() if x >= langid.OWN_RATE * best[g]} for r in rate.values()]

    def known(text):
        found = _grams(text)
        return max(sum(g in o for g in found) / len(found) for o in own)

    return [r for r in docs if re.search(r"[^\W\d_]", r[1] or "") and known(r[1]) >= corpus_pipeline.LEAST_LANGUAGE_SCORE]


def exact(docs):
    groups = defaultdict(list)
    for r in docs:
        groups["".join(words(r[1]))].append(r)
    return [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]


def near(docs):
    fps = [fingerprint(r[1]) for r in docs]
    low = [r[0] for r in docs]
    for _ in docs:
        low = [min(low[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2) for a in fps]
    return [r for r, lowest in zip(docs, low, strict=True) if r[0] == lowest]


def mixed(docs):
    size = {r[0]: len(words(r[1])) for r in docs}
    sizes = Counter()
    for r in docs:
        sizes[r[3]] += size[r[0]]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        level = Fraction(sum(sizes.values()) - sum(target.values()), sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    out = []
    for s in order:
        key = lambda r: hashlib.md5(f"{r[0]}:{'=' + r[3] if r[3] is not None else ''}:{r[1]}".encode()).hexdigest()
        left = floor(target[s])
        epochs, left = divmod(left, sizes[s])
        for r in sorted((r for r in docs if r[3] == s), key=key):
            part = max(0, min(size[r[0]], left))
            left -= part
            out += [r] * ceil((epochs * size[r[0]] + part) / size[r[0]])
    return out


def encoded(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.no_truncation()
    plain.no_padding()
    out = []
    for r in docs:
        ids = plain.encode(r[1], add_special_tokens=False).ids
        out.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(_documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_run_equals_the_stages_in_plain_python(spark, folder):
    docs = _documents()
    known = identified(docs)
    assert {r[0] for r in docs} - {r[0] for r in known} == {70, 71, 72, 73, 74} - {r[0] for r in known}
    distinct = exact(known)
    apart = near(distinct)
    taken = mixed(apart)
    assert len(docs) > len(known) > len(distinct) > len(apart) and len(taken) != len(apart)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(encoded(taken))


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, folder)
        assert out.columns == none.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, folder).count() == 0


#: Names that stages use, or have used, for columns of their own.
CLASHING = ["all", "id", "key", "sha", "n", "first", "rank", "tie", "none", "one", "fp", "lang_pred", "score", "times", "sum", "rows", "nth",
            "epoch", "__row", "__key", "__id", "__n", "__lang", "__share", "__score", "__sha", "__first", "component_id", "a.b"]


def test_stages_keep_columns_of_any_name(spark, folder):
    rows = [(*r, *(f"{c} of {i}" for c in CLASHING)) for i, r in enumerate(_documents())]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    wide = spark.createDataFrame(rows, f"{SCHEMA}, {names}").repartition(3)
    plain = spark.createDataFrame(_documents(), SCHEMA).repartition(3)
    known = {r[0]: tuple(r) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = [tuple(r) for r in stage(spark, wide, folder).collect()]
        assert all(known[r[0]] == r for r in found), name
        assert sorted(r[0] for r in found) == sorted(r.doc_id for r in stage(spark, plain, folder).collect()), name


def test_rows_without_an_id_or_with_equal_ids_are_near_copies_too(spark, folder):
    text = _documents()[40][1]
    rows = [(None, text, "en", "web", 1), (None, text, "en", "web", 2), (5, text, None, None, 3), (5, text, None, None, 4), (5, "other words", None, None, 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = corpus_pipeline.near(spark, docs, folder).collect()
    assert {(r.doc_id, r.text) for r in found} == {(5, "other words"), (5, text)} and len(found) == 2
    alone = corpus_pipeline.near(spark, docs.where("doc_id is null"), folder).collect()
    assert [(r.doc_id, r.text) for r in alone] == [(None, text)]
