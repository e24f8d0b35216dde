"""Toxicity, language and language model against plain formulas: sums over paths, differences for gradients, one loop for scores."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.llm import hmm, language, toxicity

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(300)]


def para(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def test_gradients_are_differences():
    texts = ["good day", "bad bad day", "", "worse"]
    bags, rng = toxicity.Bags(texts), np.random.default_rng(2)
    y, weights, batch = np.array([0, 1, 0, 1]), np.array([1.0, 2.0, 1.0, 2.0]), np.arange(4)
    model = toxicity.Model(rng.normal(0, 0.1, (toxicity.BUCKETS, 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2))
    _, met, to_emb, to_out, to_bias = toxicity.gradients(model, bags, batch, y, weights)
    assert set(met) == set(bags.flat.tolist())
    for values, got, places in ((model.embeddings, to_emb, [((met[i], d), (i, d)) for i in (0, 3, len(met) - 1) for d in range(3)]), (model.out, to_out, [((d, c), (d, c)) for d in range(3) for c in range(2)]), (model.bias, to_bias, [((c,), (c,)) for c in range(2)])):
        for at, own in places:
            losses = []
            for step in (1e-2, -2e-2):
                values[at] += step
                losses.append(toxicity.gradients(model, bags, batch, y, weights)[0])
            values[at] += 1e-2
            assert got[own] == pytest.approx((losses[0] - losses[1]) / 2e-2, abs=2e-3)


def test_score_is_the_mean_of_means(spark):
    rng = np.random.default_rng(4)
    weight, bias = rng.normal(0, 9, toxicity.BUCKETS), -0.4
    rows = [(i, t, "s", i) for i, t in enumerate([para(40), "Mixed CASE, words; wörds!", " ", "", None, "- - -", para(9000)] + [para(3)] * 2)]
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int"), (weight, bias), "doc_id", "score", "predicted").collect()
    for r, (i, t, s, p) in zip(got, rows):
        each = [sum(weight[g] for g in toxicity.features(w)) / max(1, len(toxicity.features(w))) for w in (t or "").split()]
        want = 1 / (1 + math.exp(-(bias + sum(each) / max(1, len(each)))))
        assert tuple(r)[:3] == (i, s, p) and r[3] == pytest.approx(want) and r[4] == (r[3] >= 0.7)


def test_toxicity_of_odd_tables(spark):
    rows = [(1, "same words"), (1, "same words"), (1, "other"), (None, "same words"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    sample = sorted(tuple(r) for r in toxicity.sample(docs, labels, "toxic", toxicity.SAMPLE).collect())
    assert sample == [(1, "other", 1), (3, "", 0)]
    model = toxicity.fit(docs, labels)
    scores = {(r.doc_id, r.text): r.score for r in toxicity.scored(docs, model, "doc_id", "text").collect()}
    assert len(scores) == 5 and scores[(2, None)] == scores[(3, "")] and scores[(None, "same words")] == scores[(1, "same words")]
    assert toxicity.scored(docs.limit(0), model, "doc_id").count() == 0


def paths(emit, start, moves):
    """Label marginals by enumeration."""
    n, k = emit.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = math.exp(start[path[0]] + sum(emit[i, x] for i, x in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        for i, x in enumerate(path):
            out[i, x] += p
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_marginals_are_sums_over_paths(block):
    rng = np.random.default_rng(5)
    sums, start, moves = rng.normal(0, 2, (6, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, (3, 3))
    chains = [rng.integers(0, 6, n) for n in (5, 0, 1, 7, 2, 6, 7)]
    got = language.marginal_sums(chains, sums, start, moves, block)
    for own, c in zip(got, chains):
        assert own == pytest.approx(paths(sums[c], start, moves).sum(axis=0) if len(c) else np.zeros(3))
    c = chains[3]
    gamma = language.marginals(sums[c][None], start, moves, np.array([7]))
    assert gamma[0] == pytest.approx(paths(sums[c], start, moves))


def test_language_of_odd_tables(spark, monkeypatch):
    rows = [(i, ["xx", "yy"][i % 2], " ".join(w + ["ing", "heit"][i % 2] for w in RNG.sample(WORDS, 20)), "a", 1) for i in range(40)]
    rows += [(None, "xx", rows[0][2], "b", 2), (0, "xx", rows[0][2], "c", 3), (50, "xx", " ".join([rows[0][2]] * 300), "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, lang_pred string, score int")
    field = language.fit(docs)
    got = language.identify(docs, field, "doc_id", "lang_pred", "score").collect()
    assert [tuple(r)[:3] for r in got] == [(r[0], r[3], r[4]) for r in rows]
    assert [tuple(r)[3] for r in got] == [r[1] for r in rows] and tuple(got[0])[3:] == tuple(got[40])[3:] == tuple(got[41])[3:]
    monkeypatch.setattr(language, "LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.fit(docs)


def test_baum_welch_counts_are_sums_over_paths():
    rng = np.random.default_rng(1)
    model = hmm.Model(rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 4, 2).T)
    seqs = [np.array(s) for s in ([0, 3, 1, 2], [2], [1, 1, 0])]
    states, moves, start = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2)
    for s in seqs:
        each = {}
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.moves[a, b] * model.emit[x, b]
            each[path] = p
        for path, p in each.items():
            p /= sum(each.values())
            start[path[0]] += p
            for x, y in zip(s, path):
                states[x, y] += p
            for a, b in zip(path, path[1:]):
                moves[a, b] += p
    own, s, m, a = hmm.expected(model, seqs)
    full = np.zeros((4, 2))
    full[own] = s
    assert full == pytest.approx(states) and m == pytest.approx(moves) and a == pytest.approx(start)
    prior = np.full(4, 0.25)
    new = hmm.maximized(states, moves, start, prior)
    assert new.emit.sum(axis=0) == pytest.approx(1) and new.moves.sum(axis=1) == pytest.approx(1) and new.start == pytest.approx((start + 0.1) / (start + 0.1).sum())


@pytest.mark.parametrize("cut", [1, 2, 3, 50])
def test_runs_add_up_to_whole_texts(cut):
    """Counts of runs that pass their states on are those of the sequences as one."""
    rng = np.random.default_rng(7)
    model = hmm.Model(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T)
    seqs = sorted((rng.integers(0, 5, n).astype("<u2") for n in (1, 2, 3, 6, 7, 7, 11, 20)), key=len, reverse=True)
    own, s, m, a = hmm.expected(model, seqs)
    want, got = np.zeros((5, 3)), np.zeros((5, 3))
    want[own] = s
    moves, start = np.zeros((3, 3)), np.zeros(3)
    for own, s, mm, aa in hmm.expected_whole(model, seqs, cut):
        got[own] += s
        moves += mm
        start += aa
    assert got == pytest.approx(want) and moves == pytest.approx(m) and start == pytest.approx(a)
    assert got.sum() == pytest.approx(sum(map(len, seqs))) and start.sum() == pytest.approx(len(seqs))


def test_first_model_is_of_all_runs(spark):
    """Every symbol of every text counts in the first model, also behind the first 256 and in more than 1,200 texts, which were its bounds before."""
    rng = np.random.default_rng(6)
    same = np.zeros(hmm.CUT, dtype="<u2")
    kinds = [rng.permutation(np.arange(1 + 20 * j, 21 + 20 * j)) for j in (0, 1)]
    texts = [np.append(same, rng.choice(kinds[i % 2], 2 * hmm.CUT + i % 5)).astype("<u2") for i in range(1300)]
    encoded = spark.createDataFrame([(bytearray(t.tobytes()),) for t in [*texts, np.zeros(0, dtype="<u2")]], "symbols binary").repartition(5)
    flat = np.concatenate(texts)
    for cut in (1, 7, 256, 10_000):
        assert (hmm.dealt_runs(encoded, rng.normal(size=(41, 3)), cut).sum(axis=1) == np.bincount(flat, minlength=41)).all()
    prior = np.bincount(flat, minlength=41) / len(flat)
    for states in (1, 2, 3):
        model = hmm.seeded(encoded, prior, states, 2)
        assert model.emit.shape == (41, states) and model.emit.sum(axis=0) == pytest.approx(1) and model.moves.sum(axis=1) == pytest.approx(1)
    ratio = np.log(model.emit[1:41, :, None] / model.emit[1:41, None, :]).max(axis=(1, 2))
    assert (ratio > 1).all()  # words that stand behind the first run only tell the states apart
