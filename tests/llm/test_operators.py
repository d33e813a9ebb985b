"""The operators on a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import bpe, embeddings, exact_dedup, langid, line_dedup, lm_score, mixing, pii, simhash, substrings, suffixes
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, name string, row int, level int, fp int, key int"
LONG = "".join(f"word{i % 977} " for i in range(9000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
EN = "the cat sat on the mat and the dog ran to the house with the other children "
DE = "der hund und die katze liegen auf dem boden und der mann geht nach hause "
TEXTS = [
    None,
    "",
    " \t\n\r\x0b\x0c",
    "123 456",
    EN * 3,
    EN.replace(" ", "  ") * 3,
    DE * 3,
    EN * 3,
    LONG,
    LONG + "x",
    LONG,
    f"alpha beta\n{PASSAGE}\ngamma",
    f"other start\n{PASSAGE}\nother end",
    "İstanbul ß é <|endoftext|> é's don't 🙂",
    "a" * 3000,
    "ab" * 150,
    "x",
    "mail me.a@b.example.org or 10.0.0.255, call +1 (555) 010-9999; card 4111 1111 1111 1111, not 10.0.0.256",
    "a@b.c_d@e.f a@b.c. +1 12 1.2.3.4.5.6.7.8 4111 1111 1111 1112",
]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, ("en", "de", None)[i % 3], (None, "a", "b", "c")[i % 4], None, "n", 1, 2, 3, 4) for i, t in enumerate(TEXTS)]
    found[4] = (4, TEXTS[4], "en", "a", None, "n", 1, 2, 3, 4)
    found[6] = (6, TEXTS[6], "de", "a", None, "n", 1, 2, 3, 4)
    return [*found, found[7], (None, "x", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def same(got, want):
    order = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_exact(docs, none, rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want, seen = [], set()
    for r in rows:
        group = [x for x in rows if body(x[1]) == body(r[1])]
        best = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        first = (best[0], body(r[1])) not in seen
        kept = r[0] == best[0] and len(r[1] or "") == len(best[1] or "") and first
        if kept:
            seen.add((best[0], body(r[1])))
        want.append((r[0], best[0], len(group), kept, hashlib.sha256(body(r[1]).encode()).hexdigest()))
    same(exact_dedup.exact_duplicates(docs).collect(), want)
    assert exact_dedup.exact_duplicates(none).count() == 0
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    same([(r[0],) for r in kept.collect()], [(w[0],) for w in want if w[3]])


def test_exact_names_blocks_pairwise(spark):
    texts = ["abcdefgh", "abcdefgx", "abcdefgh", "abcd", "abcdabcd", "abcdefghi", "xbcdefghi", "é" * 7, "é" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = exact_dedup.identities(df, block=2).collect()
    name = {r["doc_id"]: (r["level"], r["name"]) for r in found}
    assert all((name[i] == name[j]) == (a == b) for i, a in enumerate(texts) for j, b in enumerate(texts))


def test_simhash(docs, none, rows):
    def brute(text):
        w = words(text)
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [brute(r[1]) for r in rows]
    low = [r[0] if r[0] is not None else 10**9 for r in rows]
    for _ in rows:
        low = [min(low[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2) for a in fps]
    same(simhash.near_duplicates(docs).collect(), [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, low, strict=True)])
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_per_group(docs).columns == docs.columns


def test_simhash_links_reach_two_bits_and_no_more(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 20)]
    for f in list(fps):
        for flips in ((3,), (3, 40), (3, 40, 63), (63,), (0, 63)):
            g = f
            for b in flips:
                g ^= 1 << b if b < 63 else -(1 << 63)
            fps.append(g)
    fps = sorted(set(fps))
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    near = {f: f for f in fps}

    def top(x):
        return x if near[x] == x else top(near[x])

    for a, b in links.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
        x, y = sorted((top(a), top(b)))
        near[y] = x
    for a in fps:
        for b in fps:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                assert top(a) == top(b)


def test_mixing(docs, none, rows):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    got = mixing.mix(docs).collect()
    same([(r["doc_id"], r["size"]) for r in got], [(r[0], size(r)) for r in rows])
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in order)
    same([tuple(r) for r in mixing.mix(docs.repartition(5)).collect()], [tuple(r) for r in got])
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += math.ceil(r["taken"] / r["size"]) if r["size"] else 0
    assert times == +want


def test_language(docs, none, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "x"
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or ""))
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    model = langid.train(docs.where("doc_id in (4, 6)"))
    assert [np.argmax(langid.shares(t, model)) for t in (EN, DE)] == [model.languages.index("en"), model.languages.index("de")]
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 9).isNull().cast("string").substr(9, 1))).collect()} >= {"und"}


def test_languages_beyond_one_word_of_bits():
    slices = np.zeros((2, langid.WORDS), np.uint64)
    found = langid.grams(EN)
    for salt in langid.MIX:
        slices[1, langid._places(found, salt)] |= np.uint64(1) << np.uint64(6)
    model = langid.Model([f"l{i}" for i in range(71)], slices, np.zeros(71))
    assert int(np.argmax(langid.shares(EN, model))) == 70


def test_bpe(docs, none, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.no_truncation()
    plain.no_padding()
    want = []
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], tuple(ids), plain.decode(ids, skip_special_tokens=False)))
    same([(a, tuple(b), c) for a, b, c in bpe.encode(docs, tokenizer_path()).collect()], want)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = [(i, len(ids), sha(" ".join(map(str, ids))), sha(text)) for i, ids, text in want]
    same(bpe.digests(docs, tokenizer_path()).collect(), digests)
    assert bpe.digests(none, tokenizer_path()).count() == 0


def test_chunks_are_cut_by_content():
    rng = np.random.default_rng(1)
    text = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(4000))
    a, b = set(bpe.chunks(text)), set(bpe.chunks("moved é " + text))
    assert "".join(bpe.chunks(text)) == text and len(a) > 20 and len(a & b) > 0.9 * len(a)


def test_substrings(docs, none, rows):
    raw = [(r[1] or "").encode() for r in rows]
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = []
    for r, b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    same(substrings.remove_repeats(docs).collect(), want)
    for hot in (0, 2):  # marks that occur more often go window by window
        same(substrings.remove_repeats(docs, hot=hot).collect(), want)
    assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        raw = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 80))).astype(np.uint8) + 97
        text = raw.tobytes()
        array = suffixes.suffix_array(raw)
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common, before = suffixes.permuted_prefixes(raw, array)
        for i, j in zip(array[1:].tolist(), array[:-1].tolist(), strict=True):
            k = 0
            while max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            assert before[i] == j and common[i] == k


def test_lines(spark, docs, none):
    got = {(r["doc_id"], r["line"]): r for r in line_dedup.repeats(docs).collect()}
    r = got[12, 1]
    assert (r["keep_doc_id"], r["keep_line"]) == (11, 1)
    assert TEXTS[12][r["start"] : r["stop"]] == PASSAGE
    assert (7, 0) in got and (5, 0) in got and (4, 0) not in got and (12, 0) not in got
    assert line_dedup.repeats(none).count() == 0
    kept = {r["doc_id"]: r for r in line_dedup.without_repeats(docs.where("doc_id in (0, 11, 12)")).collect()}
    assert kept[12]["text"] == "other start\nother end" and kept[11]["text"] == TEXTS[11] and kept[0]["text"] is None


def test_lm(docs, none, rows):
    read = {i: [*words(r[1]), "\0"] for i, r in enumerate(rows)}
    held = {i: zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2 for i, r in enumerate(rows)}
    one, two = Counter(), Counter()
    for i, t in read.items():
        if not held[i]:
            one.update(t)
            two.update(zip(["\1", *t[:-1]], t, strict=True))
    n, v, mass = sum(one.values()), len(one), lm_score.MASS
    one["\1"] = one["\0"]
    want = []
    for i, t in read.items():
        base = {w: (one[w] + 1) / (n + v + 1) for w in t}
        score = sum(math.log10((two[h, w] + mass * base[w]) / (one[h] + mass)) for h, w in zip(["\1", *t[:-1]], t, strict=True))
        low = sum(math.log10(base[w]) for w in t)
        want.append((rows[i][0], held[i], len(t), sum(one[w] > 0 for w in t), n, round(low, 6), round(score, 6)))
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in lm_score.score_documents(docs).collect()]
    same(got, want)
    assert lm_score.score_documents(none).count() == 0


def test_pii_base(docs, none, rows):
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]

    want = []
    for r in rows:
        spans = [(k, m.start(), m.end()) for k, p in base.items() for m in re.finditer(p, r[1] or "") if good(k, m[0])]
        text = ",".join("{}:{}:{}".format(*s) for s in spans)
        want.append((r[0], *(sum(s[0] == k for s in spans) for k in base), hashlib.sha256(text.encode()).hexdigest(), text))
    same(pii.report(docs).collect(), want)
    assert pii.report(none).count() == 0


def test_pii_learns_contexts(spark):
    seeds = [f"w{i} mobil: +49 30 1234{i:03d} ende" for i in range(12)]
    texts = [*seeds, "nochmal mobil: 0301 234 5678 ende", "sonst ende 0301 234 9999 wort", "seite 0301 234 1111 zeile"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert spans[12] == "phone:15:28" and spans[14] == ""


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    vectors = [list(map(float, rng.normal(size=8))) for _ in range(60)]
    vectors += [[x + float(d) for x, d in zip(v, rng.normal(size=8) * 0.25, strict=True)] for v in vectors[:40]]
    vectors += [vectors[0], [2 * x for x in vectors[0]], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] * 8, None, [], [1.0, 2.0], [2.0, 4.0], [1e30] * 8]
    ids = [*range(len(vectors) - 1), None]
    unit = [None if not v or None in v or not np.isfinite(v).all() or not any(v) else np.array(v) / np.linalg.norm(v) for v in vectors]
    linked = [[a is not None and b is not None and len(a) == len(b) and i != j and a @ b >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    low = [i if i is not None else 10**9 for i in ids]
    for _ in ids:
        low = [min([low[i], *(low[j] for j in range(len(ids)) if linked[i][j])]) for i in range(len(ids))]
    want = [(i, sum(n), None if c == 10**9 else c, i is not None and i == c) for i, n, c in zip(ids, linked, low, strict=True)]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id bigint, embedding array<float>")
    wide = df.selectExpr("*", "1 as row", "2 as weight", "'x' as vector", "3 as root")
    same(embeddings.near_duplicates(wide).collect(), want)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_tiles_and_leaves_miss_nothing(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    points = centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8)) * 0.3
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    assert [got[i] for i in range(400)] == want.tolist()
