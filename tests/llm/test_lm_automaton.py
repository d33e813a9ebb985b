"""The backoff automaton: arcs, failure arcs, and probabilities that sum to one."""

from __future__ import annotations

from collections import Counter
from math import isclose, log10

import numpy as np

from tidemark.llm import lm_score

TRAINING = ["a b c", "a b", "b c a b", "d"]


def model():
    one, two = Counter(), Counter()
    for text in TRAINING:
        words = ["<s>", *text.split(), "</s>"]
        one.update(words[1:])
        two.update(zip(words, words[1:], strict=False))
    return one, two


def walk(text, mass=lm_score.MASS):
    """The weights of the arcs that a text takes, with an explicit state and failure arcs that read nothing."""
    one, two = model()
    total, types = one.total(), len(one)
    state, out = "<s>", []
    for token in [*text.split(), "</s>"]:
        weight = 0.0
        held = len(TRAINING) if state == "<s>" else one[state]
        p0 = (one[token] + 1) / (total + types + 1)
        if held and not two[state, token]:  # failure arc to the empty state
            weight += log10(mass / (held + mass))
            held = 0
        weight += log10((two[state, token] + mass * p0) / (held + mass)) if held else log10(p0)
        out.append(weight)
        state = token if one[token] else ""  # an unknown token leads to the empty state
    return out


def test_scores_are_those_of_the_walk(spark):
    texts = [*TRAINING, "a c", "c c zz a b", "zz zz", "", "d a"]
    docs = spark.createDataFrame([(i, t, i < len(TRAINING)) for i, t in enumerate(texts)], "doc_id bigint, text string, learn boolean")
    from pyspark.sql import functions as F

    found = {r.doc_id: r.score for r in lm_score.score(docs, F.col("learn")).collect()}
    assert all(isclose(found[i], sum(walk(t)), rel_tol=1e-12, abs_tol=1e-12) for i, t in enumerate(texts))


def test_an_unseen_pair_takes_the_failure_arc_and_an_unknown_word_does_not():
    one, _ = model()
    total, types = one.total(), len(one)
    token, state, arc = (np.array(x, float) for x in ([3, 3, 0], [2, 0, 2], [0, 0, 0]))
    root, taken = lm_score.automaton(token, state, arc, total, types)
    fail = log10(lm_score.MASS / (2 + lm_score.MASS))
    assert np.allclose(taken - root, [fail, 0, fail])


def test_each_state_sums_to_one():
    one, two = model()
    total, types = one.total(), len(one)
    tokens = [*one, None]  # the unknown one has a count of zero
    for h, held in [*one.items(), ("<s>", len(TRAINING)), ("", 0)]:
        counts = [np.array([float(x) for x in xs]) for xs in ([one[t] if t else 0 for t in tokens], [held] * len(tokens), [two[h, t] for t in tokens])]
        root, taken = lm_score.automaton(*counts, total, types)
        assert isclose(sum(10**root), 1, rel_tol=1e-9)
        if h != "</s>":  # nothing follows the end
            assert isclose(sum(10**taken), 1, rel_tol=1e-9)
