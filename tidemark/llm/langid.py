"""Language identification with language-bitmask n-gram filters.

The model is one bit-sliced Bloom filter: an array of 64-bit words in which bit
``l`` of every word belongs to the Bloom filter of language ``l``. An n-gram
(four bytes of the lower-cased text, letters only, words apart) sets its bit in
``HASHES`` words; the AND of those words returns all languages that contain it
in one lookup. A text's n-grams are looked up together, the bits are counted
per language, each count is corrected for the false positives that the fill of
that language's slice lets expect, and the largest corrected share decides.

An n-gram is a language's own if its rate among the language's n-grams reaches
``OWN_RATE`` times its largest rate in any language, so that an n-gram common
to several languages is kept for all of them, and a word that strayed into
another language's texts is not.

Training reads the text and language of all rows it is given, or of a sample
with ``SAMPLE`` expected rows a language, taken by a hash of id and text; each
language keeps its ``GRAMS`` most frequent n-grams. Both bounds size the
classifier alone: prediction covers every whole text. The filter has a fixed
size (``WORDS`` words of 8 bytes for every 64 languages) and is broadcast; more
than ``MOST_LANGUAGES`` different labels are an error, as they cannot be languages.

Defined results: a text that is null or without a letter is ``und`` with score
0; a text whose n-grams are all unknown gets the language with most training
rows and score 0; without any training row all texts are ``und``. Ties go to
the language with more training rows, then to the smaller name. A null id
counts as the empty text where rows are dealt by id. Repeated rows are all
returned, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import packed, remainder

UNKNOWN = "und"
SAMPLE = 4_000
GRAMS = 30_000
#: Labels that training accepts: at most 64 MB of filters.
MOST_LANGUAGES = 512
OWN_RATE = 0.3
WORDS = 1 << 20
HASHES = 2
SIZE = 4
STEP = 1 << 18
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


class Model(NamedTuple):
    languages: list[str]  # by training rows, most first
    slices: np.ndarray  # (ceil(languages / 64), WORDS) of uint64
    false: np.ndarray  # a language's rate of false positives


def grams(text: str) -> np.ndarray:
    """The n-grams of a whole text, each as a 32-bit number."""
    flat = b"  " + NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass") + b"  "
    raw = np.frombuffer(flat, np.uint8).astype(np.uint32)
    return raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24


def _places(found: np.ndarray, salt: np.uint64) -> np.ndarray:
    return ((found.astype(np.uint64) + np.uint64(1)) * salt >> np.uint64(44)).astype(np.int64) % WORDS


def sampled(labelled: DataFrame, id_col: str, lang_col: str, sample: int) -> DataFrame:
    """About ``sample`` rows of each language, chosen by a hash of id and text; all rows of languages with fewer.

    ``train`` has checked that there is one row of shares for each of a few hundred languages at most."""
    share = labelled.groupBy(lang_col).agg((F.lit(float(sample)) / F.count("*")).alias("__share"))
    spread = (F.xxhash64(*(F.col(c) for c in labelled.columns if c != lang_col)).cast("double") / 2.0**64) + 0.5
    return labelled.join(F.broadcast(share), lang_col).where(spread < F.col("__share")).drop("__share")


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> Model:
    """Learn from the rows of ``labelled`` whose language is not null."""
    labelled = labelled.where(F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}  # one row a language
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                texts.setdefault(lang.as_py(), []).append(grams(text.as_py() or ""))
            for lang, found in texts.items():
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
                )

    rows = sampled(labelled, id_col, lang_col, sample).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))
    own = counts.withColumn("rate", rate).withColumn("place", place).where(F.col("place") <= GRAMS)
    own = own.withColumn("best", best).where(F.col("rate") >= OWN_RATE * F.col("best"))
    learned = own.select("lang", "gram").toPandas()  # at most GRAMS rows a language
    slices = np.zeros(((len(languages) + 63) // 64 or 1, WORDS), np.uint64)
    false = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        found = learned["gram"][learned["lang"] == lang].to_numpy(np.int64)
        bit = np.uint64(1) << np.uint64(i % 64)
        for salt in MIX[:HASHES]:
            slices[i // 64, _places(found, salt)] |= bit
        false[i] = np.mean(slices[i // 64] & bit != 0) ** HASHES
    return Model(languages, slices, false)


def shares(text: str, model: Model) -> np.ndarray:
    """For each language the share of the text's n-grams that its filter holds, corrected for false positives."""
    found = grams(text)
    hits = np.zeros(len(model.languages))
    for at in range(0, len(found), STEP):
        first, second = (_places(found[at : at + STEP], salt) for salt in MIX)
        for k, words in enumerate(model.slices):
            held = words[first] & words[second]
            for i in range(k * 64, min(len(hits), k * 64 + 64)):
                hits[i] += np.count_nonzero(held & (np.uint64(1) << np.uint64(i % 64)))
    return np.clip((hits / len(found) - model.false) / (1 - model.false), 0, 1)


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score added, or put in place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"{names[0]} string, {names[1]} double")
    def guess(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        model, out = shared.value, []
        for text in texts:
            if not model.languages or not text or not LETTER.search(text):
                out.append((UNKNOWN, 0.0))
            else:
                found = shares(text, model)
                best = int(np.argmax(found))
                out.append((model.languages[best], float(found[best])))
        return pd.DataFrame(out, columns=list(names))

    rest = [c for c in docs.columns if c not in names]
    return docs.withColumn("__guess", guess(F.col(text_col))).select(*rest, "__guess.*")


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 4) == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).drop("text")


def keep_identified(
    docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs``, with their columns as they are, whose text has a language with a score of ``least`` or more."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    guessed = predict(packed(docs, text=F.col(text_col)), model)
    return guessed.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("all.*")
