"""The tokenizer's cache, and the schedule against a round-robin that goes queue after queue."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from dendrospark.llm import packing

RNG = random.Random(5)
P = pytest.importorskip("public_tokenizers")


def test_words_and_spaces():
    words = packing.WordTokenizer(P.path("byte_bpe_50k.json"))
    texts = ["a  b", " a", "a ", "a\n b", "a \tb", "", " ", "\n\n x", "don't  do", "é ü\u00a0 x  ", "a <|endoftext|> b", "a b", "b b a\nb", "a \u00a0b", "a \u0085b", "a\u2003 b"]
    for limit in (400_000, 2):
        words.limit = limit
        ids, n = words.encode(texts * 2, 0)
        want = [[*words.model.encode(t, add_special_tokens=False).ids, 0] for t in texts * 2]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def in_turn(totals, weights, window):
    """Deficit round-robin, queue after queue and window after window: what each has been served after each."""
    left, deficit, out = list(totals), [Fraction(0)] * len(totals), [[0] * len(totals)]
    owed = [Fraction(t) for t in totals]  # not yet given as quanta
    while sum(left):
        budget = Fraction(window)
        while budget and any(owed):
            live = [q for q in range(len(totals)) if owed[q] and weights[q]] or [q for q in range(len(totals)) if owed[q]]
            share = {q: Fraction(weights[q]) or Fraction(totals[q]) for q in live}
            step = min(budget / sum(share.values()), min(owed[q] / share[q] for q in live))  # until one is dry
            for q in live:
                owed[q] -= step * share[q]
                deficit[q] += step * share[q]
            budget -= step * sum(share.values())
        for q in range(len(totals)):
            now = min(left[q], math.floor(deficit[q]))
            left[q], deficit[q] = left[q] - now, deficit[q] - now
        out.append([t - x for t, x in zip(totals, left)])
    return out


@pytest.mark.parametrize("weights", [[1, 1, 1, 1], [5, 1, 2, 0.5], [4, 0, 1, 0], [0, 0, 0, 0]])
def test_schedule_is_round_robin(weights):
    totals = [700, 91, 300, 57]
    signed = np.array([float(w or -n) for w, n in zip(weights, totals)])
    plan = packing.Rounds.of(np.array(totals), signed, 100)
    for w, want in enumerate(in_turn(totals, weights, 100)):
        assert plan.served(np.array(totals), signed, np.full(4, w)).tolist() == want


def test_shares_in_each_window(spark):
    rows = [(i, " ".join(RNG.choice(["red", "blue", "greenish"]) for _ in range(60)), "ab"[i % 2] if i % 5 else "c") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of, windows = {i: s for i, _, s in rows}, {}
    for r in packing.pack(docs, P.path("byte_bpe_50k.json"), {"a": 3.0}, 1.0, sequence=64, window_sequences=20).collect():
        windows.setdefault(r.window, Counter())[of[r.doc_id]] += r.length
    for own in [windows[w] for w in range(3)]:
        assert abs(own["a"] - 768) <= 1 and abs(own["b"] - 256) <= 1 and abs(own["c"] - 256) <= 1
    with pytest.raises(ValueError):
        packing.pack(docs, "", {"a": -1.0})
