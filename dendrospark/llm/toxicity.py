"""Toxicity by subword-bag embeddings and a linear softmax (operator 4).

A word's vector is the mean of the embeddings of its character n-grams (hashed)
and of itself; a text's vector is the mean over its words; a linear softmax on
it gives the score. Embeddings and softmax are trained jointly in numpy on a
bounded sample of labelled rows. Misspellings share n-grams with what they
misspell, so they get near vectors.

An n-gram has an embedding if the label stands out among the training texts that hold it (by Z standard
deviations, in MIN_TEXTS texts at least), and begins at its log-odds; others are zero, also those that training never met.
Labels are weighted equally. Two half-trained models score each other's halves of the sample, and a logistic curve
through these scores sets the scale on which the final model's scores are read.

A trained model is linear in the word vectors, so scoring needs one number for
each hashed feature, and each word's sum is kept while a task runs.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.llm.common import fold, mapped, slices, table, words_of

BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 17, 8, 3, 6  # n-gram lengths in bytes
#: Bounds of the training sample: rows of each label, and bytes of a text that may be in it.
SAMPLE = {1: 2000, 0: 3500}
SAMPLE_BYTES = 64_000
MIN_TEXTS, Z = 2, 3.0
GAIN, RATE, BATCH, DECAY = 25.0, 0.05, 64, 1e-4
#: Texts that training goes through, in LEAST to MOST epochs.
PASSES, LEAST, MOST = 20_000, 4, 30
CACHE = 500_000
THRESHOLD = 0.7

_edges = re.compile(r"^\W+|\W+$")


def features(token: str) -> list[int]:
    """Hashed n-grams of a token without the signs around it, and the word itself."""
    word = b"<" + _edges.sub("", token.lower()).encode("utf-8", "surrogatepass") + b">"
    n, crc = len(word), zlib.crc32
    if n == 2:
        return []
    out = {crc(word[i : i + k]) % BUCKETS for k in range(SHORTEST, LONGEST + 1) for i in range(n - k + 1)}
    out.add(crc(word, 1) % BUCKETS)
    return sorted(out)


def flat_features(words: Iterable[str], of: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many features each word has, and all of them in one array."""
    size, flat = array("i"), array("i")
    for w in words:
        f = of(w)
        size.append(len(f))
        flat.extend(f)
    return np.array(size, dtype=np.int64), np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, dtype=np.int32)


class Bags:
    """Texts as bags of words, and the features of each word."""

    def __init__(self, texts: list[str]):
        own, at, many = words_of(texts)
        self.docs = []
        for words in np.split(at, np.cumsum(many)[:-1]):
            ids, n = np.unique(words, return_counts=True)
            self.docs.append((ids, (n / max(1, n.sum())).astype(np.float32)))
        self.size, self.flat = flat_features(own, features)
        self.first = np.cumsum(self.size) - self.size
        self.share = (1 / np.maximum(1, self.size)).astype(np.float32)  # of a feature in its word

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of words one after another, and of which of them each is."""
        n = self.size[words]
        return self.flat[np.repeat(self.first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(np.arange(len(words)), n)

    def only(self, keep: np.ndarray) -> Bags:
        """The same texts with the features of ``keep``; a word's others are zero in its mean."""
        out = copy(self)
        on = keep[self.flat]
        out.size = np.bincount(np.repeat(np.arange(len(self.size)), self.size)[on], minlength=len(self.size))
        out.flat, out.first = self.flat[on], np.cumsum(out.size) - out.size
        return out


@dataclass
class Model:
    embeddings: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _summed(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, d], rows) for d in range(values.shape[1])], axis=1).astype(np.float32)


def gradients(model: Model, bags: Bags, batch: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The weighted mean loss of some texts; features met, and the gradients of their embeddings, of out and of bias."""
    words = np.concatenate([bags.docs[i][0] for i in batch])
    share = np.concatenate([bags.docs[i][1] for i in batch])
    row = np.repeat(np.arange(len(batch)), [len(bags.docs[i][0]) for i in batch])
    own, at = np.unique(words, return_inverse=True)
    gram, of = bags.grams(own)
    vectors = _summed(of, model.embeddings[gram], len(own)) * bags.share[own][:, None]
    hidden = GAIN * _summed(row, vectors[at] * share[:, None], len(batch))
    logits = hidden @ model.out + model.bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.arange(len(batch)), labels
    loss = float(-(np.log(p[right]) * weights).sum() / len(batch))
    p[right] -= 1
    p *= weights[:, None] / len(batch)
    to_hidden = GAIN * p @ model.out.T
    to_words = _summed(at, to_hidden[row] * share[:, None], len(own)) * bags.share[own][:, None]
    met = np.flatnonzero(np.bincount(gram, minlength=BUCKETS))
    return loss, met, _summed(gram, to_words[of], BUCKETS)[met], hidden.T @ p, p.sum(axis=0)


def standing_out(bags: Bags, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The log-odds of label 1 of each feature where the label stands out, else 0."""
    met = np.zeros((2, BUCKETS), dtype=np.int64)
    for i in rows:
        met[y[i], np.unique(bags.grams(bags.docs[i][0])[0])] += 1
    n, texts = met.sum(axis=0), np.bincount(y[rows], minlength=2)
    q = texts[1] / max(1, len(rows))
    z = (met[1] - n * q) / np.sqrt(n * q * (1 - q) + 1e-9)
    odds = np.log((met[1] + 1) / (texts[1] + 2)) - np.log((met[0] + 1) / (texts[0] + 2))
    return np.where((n >= MIN_TEXTS) & (np.abs(z) >= Z), odds, 0.0)


def trained(bags: Bags, y: np.ndarray, rows: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """The weight of each hashed feature in the log-odds of label 1 of a text, and the bias, from the texts ``rows``."""
    rng = np.random.default_rng(seed)
    odds = standing_out(bags, y, rows)
    bags = bags.only(odds != 0)
    emb = (rng.normal(0, 0.1 / WIDTH, (BUCKETS, WIDTH)) * (odds != 0)[:, None]).astype(np.float32)
    emb[:, 0] = odds
    out = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    out[0] = -0.5, 0.5
    model = Model(emb, out, np.zeros(2, dtype=np.float32))
    sums = [np.full_like(x, 1e-8) for x in (model.embeddings, model.out, model.bias)]
    even = len(rows) / (2 * np.maximum(1, np.bincount(y[rows], minlength=2)))
    for _ in range(int(np.clip(PASSES / len(rows), LEAST, MOST)) if len(rows) else 0):
        order = rng.permutation(rows)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            _, met, to_emb, to_out, to_bias = gradients(model, bags, batch, y[batch], even[y[batch]])
            to_emb = to_emb + DECAY * model.embeddings[met]
            sums[0][met] += to_emb**2
            model.embeddings[met] -= RATE * to_emb / np.sqrt(sums[0][met])
            for x, g, s in ((model.out, to_out, sums[1]), (model.bias, to_bias, sums[2])):
                s += g**2
                x -= (RATE * g / np.sqrt(s)).astype(np.float32)
    return (GAIN * model.embeddings @ (model.out[:, 1] - model.out[:, 0])).astype(np.float64), float(model.bias[1] - model.bias[0])


def log_odds(bags: Bags, model: tuple[np.ndarray, float], rows: np.ndarray) -> np.ndarray:
    words = np.bincount(np.repeat(np.arange(len(bags.size)), bags.size), model[0][bags.flat], len(bags.size)) * bags.share
    return np.array([model[1] + float(words[bags.docs[i][0]] @ bags.docs[i][1]) for i in rows])


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the logistic curve of a * z + b through labels, both weighted equally; (1, 0) where there is one label only."""
    n = np.bincount(y, minlength=2)
    if not n.all():
        return 1.0, 0.0
    w, t = (len(y) / (2 * n))[y], np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g, h = w * (p - t), w * p * (1 - p) + 1e-9
        slope = np.array([(g * z).sum() + 1e-6 * a, g.sum()])
        bend = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(bend, slope), -1, 1)
        a, b = a - step[0], b - step[1]
    return max(float(a), 0.0), float(b)


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """The weight of each hashed feature in the calibrated log-odds of label 1 of a text, and the bias.

    Empty texts have no words. Without texts, or with one label only, all that is left is the bias.
    """
    bags, y = Bags(texts), np.array(labels, dtype=np.int64)
    rows = np.arange(len(y))
    z = np.zeros(len(y))
    for half in (rows[::2], rows[1::2]):
        other = np.setdiff1d(rows, half)
        z[half] = log_odds(bags, trained(bags, y, other), half)
    a, b = calibration(z, y)
    weight, bias = trained(bags, y, rows)
    return a * weight, a * bias + b


def sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int]) -> DataFrame:
    """doc_id, text and label of at most ``bounds`` ids of each label, those whose ids hash lowest.

    The ids are picked first, so no text moves that isn't in the sample. Null ids, null labels and texts that are null or longer
    than SAMPLE_BYTES aren't in it; of rows that share an id, the smallest text and the largest label are.
    """
    short = docs.where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    rows = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label")).join(short, "doc_id")
    picked = None
    for value, most in bounds.items():
        own = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = own if picked is None else picked.unionByName(own)
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], picked.schema)
    return docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> tuple[np.ndarray, float]:
    """A model of ``labels.toxic``, from the rows of ``labels`` where ``learn`` holds (default: all); without any, one that scores all texts alike.

    One task trains on the bounded sample; only the model comes to the driver.
    """
    labels = labels if learn is None else labels.where(learn)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        if parts:
            pdf = pd.concat(parts).sort_values("doc_id")
            weight, bias = train(pdf["text"].tolist(), pdf["label"].astype(int).tolist())
            yield pd.DataFrame({"weight": [weight.tobytes()], "bias": [bias]})

    found = mapped(sample(docs, labels, "toxic", SAMPLE).repartition(1), run, "weight binary, bias double").collect()
    return (np.frombuffer(found[0]["weight"]).copy(), float(found[0]["bias"])) if found else train([], [])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], *keep: str) -> DataFrame:
    """``keep`` columns, score and predicted of each row. A text without words has the score of the bias alone.

    ``keep`` may hold columns called score or predicted; the new ones come last. Null is the empty text. Repeated rows get equal scores. Whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_{i}" for i in range(len(keep))]
    text = names[keep.index("text")] if "text" in keep else "_text"
    schema = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.lit(0.0).alias("_score"), F.lit(0).alias("_predicted")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, bias = shared.value
        known: dict[str, int] = {}
        sums = np.zeros(0)

        for pdf in batches:
            scores = []
            for part in slices(["" if t is None else t for t in pdf[text]]):
                own, at, many = words_of(part)
                if len(known) > CACHE:
                    known.clear()
                    sums = np.zeros(0)
                new = [w for w in own if w not in known]
                size, flat = flat_features(new, features)
                of = np.repeat(np.arange(len(new)), size)
                sums = np.append(sums, np.bincount(of, weight[flat], len(new)) / np.maximum(1, size))
                known.update(zip(new, range(len(known), len(known) + len(new))))
                of_word = sums[np.array([*map(known.__getitem__, own)], dtype=np.int64)[at]]
                scores.append(bias + np.bincount(np.repeat(np.arange(len(part)), many), of_word, len(part)) / np.maximum(1, many))
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(scores), -500, 500)))
            yield pdf[names].assign(_score=p, _predicted=(p >= THRESHOLD).astype(np.int32))

    picked = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], *([] if "text" in keep else [F.col("text").alias(text)]))
    return mapped(picked, run, schema).toDF(*keep, "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels outside the held-out third; null and empty texts too."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return scored(docs, model, "doc_id").select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
