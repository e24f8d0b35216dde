"""Language of words and texts by a linear-chain conditional random field (operator 8).

Each word of a text gets a language label. A word's features are its affixes,
its character n-grams and itself as a lexicon entry (all hashed); transition
weights between neighbouring labels are learned with them. Training sequences
splice runs of words from texts of different languages, so that the field
learns where code switches. Marginals come from forward-backward; a text's
language is the label with the largest mean marginal.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dendrospark.llm.common import fold, mapped, slices, table, words_of
from dendrospark.llm.toxicity import flat_features

BUCKETS, AFFIX, GRAM = 1 << 16, 4, 3  # lengths in bytes
#: Bounds of the training sample: texts of each language, and bytes of a text in it. More languages than LANGUAGES are an error.
TEXTS, LANGUAGES, SAMPLE_BYTES = 600, 1024, 64_000
SEQUENCE, RUN, STEPS, BATCH, RATE = 64, 16, 240, 128, 0.3
#: Words of a chain whose states are held at once; of longer ones, the forward pass is done again from the last border.
BLOCK = 1 << 15
CACHE, UNDETERMINED = 500_000, "und"

_edges = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_letter = re.compile(r"[^\W\d_]")


def features(token: str) -> list[int]:
    """Hashed affixes, n-grams and the word itself, of a token without the signs around it; none if no letter is left."""
    w = _edges.sub("", token.lower()).encode("utf-8", "surrogatepass")
    if not w:
        return []
    n, crc = len(w), zlib.crc32
    out = [crc(w[i : i + GRAM]) % BUCKETS for i in range(n - GRAM + 1)]
    for k in range(1, min(AFFIX, n) + 1):  # prefixes, suffixes and the word start from checksums of their own
        out += (crc(w[:k], 1) % BUCKETS, crc(w[-k:], 2) % BUCKETS)
    out.append(crc(w, 3) % BUCKETS)
    return out


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    start: np.ndarray
    moves: np.ndarray  # from x to


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def marginals(emit: np.ndarray, start: np.ndarray, moves: np.ndarray, lengths: np.ndarray, edges: bool = False):
    """Label marginals of sequences (batch x words x labels) by scaled forward-backward; the expected moves too."""
    b, t, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m, alpha, beta = np.exp(moves), np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] * np.exp(start)
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * e[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (e[:, i + 1] * beta[:, i + 1]) @ m.T
        beta[:, i] = np.where((i + 1 < lengths)[:, None], x / x.sum(axis=1, keepdims=True), 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    if not edges:
        return gamma
    on = np.arange(1, t)[None, :] < lengths[:, None]
    ahead = e[:, 1:] * beta[:, 1:]
    pair = alpha[:, :-1, :, None] * m[None, None] * ahead[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return gamma, (pair * on[:, :, None, None]).sum(axis=(0, 1))


def marginal_sums(chains: list[np.ndarray], sums: np.ndarray, start: np.ndarray, moves: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Of each chain of words (rows of ``sums``, their label scores), the sum of its words' label marginals. Chains aren't cut."""
    n = np.array([len(c) for c in chains], dtype=np.int64)
    k = len(start)
    out = np.zeros((len(chains), k))
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return out
    n = n[order]
    flat, first, width = np.concatenate([chains[i] for i in order]), np.cumsum(n) - n, int(n[0])
    live = len(n) - np.cumsum(np.bincount(n, minlength=width + 1))[: width + 1]  # chains longer than t: the first ones
    m, begin = np.exp(moves), np.exp(start)

    def scores(t: int) -> np.ndarray:
        e = sums[flat[first[: live[t]] + t]].astype(np.float64)
        return np.exp(e - e.max(axis=1, keepdims=True))

    def ahead(before: np.ndarray | None, e: np.ndarray) -> np.ndarray:
        a = (begin if before is None else before[: len(e)] @ m) * e
        return a / a.sum(axis=1, keepdims=True)

    lows, borders, alpha = range(0, width, block), [], None
    for low in lows:
        borders.append(alpha)
        for t in range(low, low + block) if low + block < width else ():
            alpha = ahead(alpha, scores(t))
    total, beta, after = np.zeros((len(n), k)), np.ones((len(n), k)), None
    for low, alpha in zip(reversed(lows), reversed(borders)):
        held = []
        for t in range(low, min(low + block, width)):
            e = scores(t)
            alpha = ahead(alpha, e)
            held.append((alpha, e))
        for alpha, e in reversed(held):
            if after is not None:
                x = (after * beta[: len(after)]) @ m.T
                beta[: len(after)] = x / x.sum(axis=1, keepdims=True)
            g = alpha * beta[: len(alpha)]
            total[: len(g)] += g / g.sum(axis=1, keepdims=True)
            after = e
    out[order] = total
    return out


def train(texts: list[str], langs: list[str], seed: int = 7) -> Field | None:
    """A field for the languages given; None where there are none."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    known: dict[str, int] = {}
    pools = [[] for _ in labels]
    for t, lang in zip(texts, langs):
        w = t.split()
        if w:
            pools[labels.index(lang)].append(np.array([known.setdefault(x, len(known)) for x in w]))
    if not any(pools):
        return None
    usable = [i for i, p in enumerate(pools) if p]
    size, flat = flat_features(known, features)
    first = np.append(0, np.cumsum(size))
    k = len(labels)
    field = Field(labels, np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k)))
    seen = [np.full_like(x, 1e-6) for x in (field.weights, field.start, field.moves)]
    for _ in range(STEPS):
        ids, y = np.zeros((BATCH, SEQUENCE), dtype=np.int64), np.zeros((BATCH, SEQUENCE), dtype=np.int64)
        for i in range(BATCH):
            at = 0
            while at < SEQUENCE:
                lang = usable[rng.integers(len(usable))]
                text = pools[lang][rng.integers(len(pools[lang]))]
                n = min(SEQUENCE - at, len(text), int(rng.geometric(1 / RUN)))
                from_ = rng.integers(len(text) - n + 1)
                ids[i, at : at + n], y[i, at : at + n] = text[from_ : from_ + n], lang
                at += n
        own, place = np.unique(ids, return_inverse=True)
        place = place.reshape(ids.shape)
        n = size[own]
        word = np.repeat(np.arange(len(own)), n)
        feat = flat[np.repeat(first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        sums = np.stack([np.bincount(word, field.weights[feat, j], len(own)) for j in range(k)], axis=1)
        gamma, pair = marginals(sums[place], field.start, field.moves, np.full(BATCH, SEQUENCE), edges=True)
        truth = np.eye(k)[y]
        diff = (gamma - truth).reshape(-1, k)
        by_word = np.stack([np.bincount(place.ravel(), diff[:, j], len(own)) for j in range(k)], axis=1)
        touched, at = np.unique(feat, return_inverse=True)
        by_feat = np.stack([np.bincount(at, by_word[word, j], len(touched)) for j in range(k)], axis=1)
        moved = np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        scale = BATCH * SEQUENCE
        g = by_feat / scale + 1e-7 * field.weights[touched]
        seen[0][touched] += g**2
        field.weights[touched] -= RATE * g / np.sqrt(seen[0][touched])
        for x, g, s in ((field.start, diff.reshape(BATCH, SEQUENCE, k)[:, 0].sum(axis=0) / BATCH, seen[1]), (field.moves, (pair - moved) / scale, seen[2])):
            s += g**2
            x -= RATE * g / np.sqrt(s)
    return field


def fit(docs: DataFrame, learn=None) -> Field | None:
    """A field from at most TEXTS ids of each language, those that hash lowest; ids are picked before texts move.

    Null ids, languages and texts, and texts of more than SAMPLE_BYTES, aren't learned from; of rows that share id and
    language, the smallest text is. No rows give no field. More than LANGUAGES languages are an error.
    """
    rows = docs if learn is None else docs.where(learn)
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "lang", "text")
    known = rows.select("lang").distinct().limit(LANGUAGES + 1).count()
    if known > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.select("doc_id", "lang").withColumn("_n", F.dense_rank().over(lowest)).where(F.col("_n") <= TEXTS).select("doc_id", "lang").distinct()
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], picked.schema)
    got = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    got = sorted((r["doc_id"], r["lang"], r["text"]) for r in got)
    return train([r[2] for r in got], [r[1] for r in got])


def identify(docs: DataFrame, field: Field | None, *keep: str) -> DataFrame:
    """``keep`` columns, lang_pred and score (the mean marginal of the language) of each row, from the whole text as one chain.

    ``und`` with score 0 where the text is null or has no letter, or there is no field. Equal means go to the label that sorts first.
    Repeated rows get equal results; ``keep`` may hold columns called lang_pred or score: the new ones come last. Others are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = [f"_{i}" for i in range(len(keep))]
    schema = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.lit("").alias("_lang"), F.lit(0.0).alias("_score")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = shared.value
        if field is None:
            for pdf in batches:
                yield pdf[names].assign(_lang=UNDETERMINED, _score=0.0)
            return
        weights = field.weights.astype(np.float32)
        known: dict[str, int] = {}
        sums = np.zeros((0, len(field.labels)), dtype=np.float32)

        def learn(words: list[str]) -> None:
            nonlocal sums
            size, flat = flat_features(words, features)
            made, some = np.zeros((len(words), weights.shape[1]), dtype=np.float32), np.flatnonzero(size)
            if len(some):
                made[some] = np.add.reduceat(weights[flat], (np.cumsum(size) - size)[some], axis=0)
            known.update(zip(words, range(len(known), len(known) + len(words))))
            sums = np.concatenate([sums, made])

        for pdf in batches:
            texts = [t if t is not None and _letter.search(t) else "" for t in pdf["_text"]]
            means = []
            for part in slices(texts):
                own, at, many = words_of(part)
                if len(known) > CACHE:
                    known.clear()
                    sums = sums[:0]
                learn([w for w in own if w not in known])
                ids = np.array([*map(known.__getitem__, own)], dtype=np.int64)[at]
                means.append(marginal_sums(np.split(ids, np.cumsum(many)[:-1]), sums, field.start, field.moves))
            means = np.concatenate(means)
            total, best = means.sum(axis=1), means.argmax(axis=1)
            score = np.where(total > 0, means[np.arange(len(means)), best] / np.maximum(total, 1), 0.0)
            yield pdf[names].assign(_lang=[field.labels[b] if t else UNDETERMINED for b, t in zip(best, texts)], _score=np.clip(score, 0, 1))

    picked = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("text").alias("_text"))
    return mapped(picked, run, schema).toDF(*keep, "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a field of the documents outside the held-out third; und for null texts and those without letters."""
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, fold(F.col("doc_id"), 3) != 1)
    return identify(docs, field, "doc_id").select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
