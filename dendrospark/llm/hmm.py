"""Hidden Markov language model (operator 7).

Latent states emit symbols: each of the most frequent tokens is a symbol, and
rarer tokens fall into classes by their ending, within which a token's
probability is (c + 1) / Z from its training count. The first model and Baum-Welch are of all
training documents: each partition sums expected counts, Spark adds them by symbol,
and only the model's own tables (a fixed number of symbols) reach the driver.
A document's likelihood is the exact scaled forward recursion over its whole text.

Counts of all tokens stay a distributed table. The HEAD most frequent go to every
task; what a document holds beyond them is joined with the table by the token itself.
Long texts are trained in runs of CUT symbols, with the forward and the backward state
passed on from run to run, so that counts are those of whole texts in bounded memory.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.llm.common import cuts_of, fold, mapped, table, written

STATES, ROUNDS = 8, 2
#: Passes after each halving of states at the start, and counts by which a symbol's shares are drawn to all symbols'.
SEED_ROUNDS, SHRUNK = 2, 100.0
HEAD, CLASSES = 1 << 17, 512
SYMBOLS = (1 << 16) - CLASSES
#: Symbols of a run, and texts whose runs are taken side by side.
CUT, TEXTS = 256, 800
END = b"\n"  # no word holds a line feed
LOG10 = np.log(10.0)


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def token_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % CLASSES


def token_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """token (binary) and c over all rows; each task adds up before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                held.update(tokens(t))
                if len(held) > flush:
                    yield pd.DataFrame({"token": list(held), "c": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"token": list(held), "c": list(held.values())})

    return mapped(docs.select("text"), run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The head tokens with their counts, symbols, and what the rest sums to."""

    index: dict[bytes, int]
    counts: np.ndarray
    symbols: np.ndarray
    class_total: np.ndarray  # Z of each class
    total: int  # N
    distinct: int  # V

    @property
    def base(self) -> float:
        return np.log10(self.total + self.distinct + 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """HEAD rows at most, CLASSES sums and a histogram of log counts come to the driver."""
    n = counts.agg(F.sum("c"), F.count("*")).first()
    band = F.floor(F.log2("c") * 64).cast("int")
    least, rows = 1 << 30, 0
    for r in sorted(counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), reverse=True):
        rows += r["n"]
        if rows > HEAD:
            break
        least = r["band"]
    head = counts.where(band >= least).toPandas()
    head = head.assign(token=[bytes(t) for t in head["token"]]).sort_values(["c", "token"], ascending=[False, True])
    own = head["c"].to_numpy(np.int64)
    symbols = np.arange(len(head))
    beyond = head["token"].iloc[SYMBOLS:]
    symbols[SYMBOLS:] = [SYMBOLS + token_class(t) for t in beyond]
    totals = np.ones(CLASSES, dtype=np.float64)
    if len(head):
        low, last = int(own[min(SYMBOLS, len(head)) - 1]), bytearray(head["token"].iloc[min(SYMBOLS, len(head)) - 1])
        rare = (F.col("c") < low) | ((F.col("c") == low) & (F.col("token") > F.lit(last)))
        by = F.pmod(F.crc32(F.substring("token", -3, 3)), F.lit(CLASSES))
        for r in counts.where(rare).groupBy(by.alias("k")).agg(F.sum(F.col("c") + 1).alias("z")).collect():
            totals[int(r["k"])] += r["z"]
    return Vocabulary({t: i for i, t in enumerate(head["token"])}, own, symbols.astype(np.int64), totals, int(n[0] or 0), int(n[1]))


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per document: its symbols, sums over its head tokens, and the others with their classes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = docs.select(
        "doc_id", "row", "held_out", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("rare"),
        F.lit(b"").alias("symbols"), F.array(F.lit(b"")).alias("tail"), F.array(F.lit(0)).alias("tail_class"),
    ).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        index, log_c, log_z = v.index, np.log10(v.counts + 1.0), np.log10(v.class_total)
        in_class = np.where(v.symbols >= SYMBOLS, log_c - log_z[np.maximum(v.symbols - SYMBOLS, 0)], 0.0)
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                w = tokens(t)
                at = np.fromiter((index.get(x, -1) for x in w), dtype=np.int64, count=len(w))
                sym = np.where(at >= 0, v.symbols[at] if len(v.symbols) else 0, 0)
                tail = np.flatnonzero(at < 0)
                others = [w[i] for i in tail.tolist()]
                classes = [token_class(x) for x in others]
                sym[tail] = SYMBOLS + np.array(classes, dtype=np.int64)
                head = at[at >= 0]
                out.append(
                    (len(w), len(head), float(log_c[head].sum()) if len(head) else 0.0, float(in_class[head].sum()) if len(head) else 0.0,
                     sym.astype("<u2").tobytes(), others, classes)
                )
            made = pd.DataFrame(out, columns=["n_tokens", "known", "base", "rare", "symbols", "tail", "tail_class"])
            yield pd.concat([pdf[["doc_id", "row", "held_out"]].reset_index(drop=True), made], axis=1)

    return mapped(docs.select("doc_id", "row", "held_out", "text"), run, schema)


@dataclass
class Model:
    start: np.ndarray  # states
    moves: np.ndarray  # from x to
    emit: np.ndarray  # symbols x states


def filtered(model: Model, seqs: list[np.ndarray], before: np.ndarray | None) -> np.ndarray:
    """What is known of each sequence's last state from its symbols and those before; all are of one length."""
    grid = np.stack(seqs, axis=1)
    a = (model.start if before is None else before @ model.moves) * model.emit[grid[0]]
    a /= a.sum(axis=1, keepdims=True)
    for row in grid[1:]:
        a = (a @ model.moves) * model.emit[row]
        a /= a.sum(axis=1, keepdims=True)
    return a


def expected_run(
    model: Model, seqs: list[np.ndarray], before: np.ndarray | None = None, after: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts by scaled forward-backward: symbols met, their states, moves, starts; and the message to what stands before.

    ``seqs`` come longest first. ``before``: the filtered states of the symbols before them (None: texts begin here),
    ``after``: the messages, up to a factor, that come back to their last symbols (None: they end here).
    """
    k = len(model.start)
    n = np.array([len(s) for s in seqs])
    width = n[0]
    grid = np.zeros((len(seqs), width), dtype=np.int64)
    for i, s in enumerate(seqs):
        grid[i, : len(s)] = s
    on = np.arange(width)[None] < n[:, None]
    live = on.sum(axis=0)
    e = model.emit[grid.T]  # words x sequences x states
    alpha = np.empty_like(e)
    a = (model.start if before is None else before @ model.moves) * e[0]
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, width):
        m = live[t]
        a = (alpha[t - 1, :m] @ model.moves) * e[t, :m]
        alpha[t, :m] = a / a.sum(axis=1, keepdims=True)
    moves = np.zeros((k, k))
    beta = np.ones((len(seqs), k)) if after is None else after.copy()
    gamma = alpha
    last = alpha[n - 1, np.arange(len(seqs))] * beta
    gamma[n - 1, np.arange(len(seqs))] = last / last.sum(axis=1, keepdims=True)  # read below only as what it is
    for t in range(width - 2, -1, -1):
        m = live[t + 1]
        ahead = e[t + 1, :m] * beta[:m]
        back = ahead @ model.moves.T
        scale = 1 / (alpha[t, :m] * back).sum(axis=1, keepdims=True)
        moves += alpha[t, :m].T @ (ahead * scale)
        beta[:m] = back / back.sum(axis=1, keepdims=True)
        g = alpha[t, :m] * beta[:m]
        gamma[t, :m] = g / g.sum(axis=1, keepdims=True)
    ahead = e[0] * beta
    back = ahead @ model.moves.T
    if before is not None:
        moves += before.T @ (ahead / (before * back).sum(axis=1, keepdims=True))
    moves *= model.moves
    flat, g = grid.T[on.T], gamma[on.T]
    own, at = np.unique(flat, return_inverse=True)
    states = np.stack([np.bincount(at, g[:, s], len(own)) for s in range(k)], axis=1)
    start = gamma[0].sum(axis=0) if before is None else np.zeros(k)
    return own, states, moves, start, back / back.sum(axis=1, keepdims=True)


def expected(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of sequences at once: symbols met, their states, moves, starts."""
    return expected_run(model, sorted(seqs, key=len, reverse=True))[:4]


def expected_whole(model: Model, seqs: list[np.ndarray], cut: int = CUT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The first four of ``expected_run`` for whole sequences, longest first, run by run from the last to the first.

    Only the filtered states at the ends of runs are kept for all runs at once.
    """
    runs = np.array([-(-len(s) // cut) for s in seqs])
    ends: list[np.ndarray | None] = [None]
    for r in range(runs[0] - 1):
        many = int((runs > r + 1).sum())  # those that go on
        before = None if ends[r] is None else ends[r][:many]
        ends.append(filtered(model, [s[r * cut : (r + 1) * cut] for s in seqs[:many]], before))
    after = np.ones((0, len(model.start)))
    for r in range(runs[0] - 1, -1, -1):
        many = int((runs > r).sum())
        after = np.concatenate([after, np.ones((many - len(after), len(model.start)))])  # those that end in this run
        own, states, moves, start, after = expected_run(model, [s[r * cut : (r + 1) * cut] for s in seqs[:many]], ends[r], after)
        yield own, states, moves, start


def maximized(states: np.ndarray, moves: np.ndarray, start: np.ndarray, prior: np.ndarray) -> Model:
    """The model of expected counts (symbols x states), each smoothed by the symbols' overall shares."""
    emit = states + 20.0 * prior[:, None] * len(prior) ** 0.5
    emit = 0.98 * emit / emit.sum(axis=0) + 0.02 * prior[:, None]
    moves, start = moves + 0.1, start + 0.1
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit)


def _side_by_side(raw: list[bytes]) -> Iterator[list[np.ndarray]]:
    """The sequences, longest first, TEXTS at a time."""
    seqs = sorted((np.frombuffer(r, dtype="<u2") for r in raw), key=len, reverse=True)
    for at in range(0, len(seqs), TEXTS):
        yield seqs[at : at + TEXTS]


def baum_welch(encoded: DataFrame, prior: np.ndarray, rounds: int, model: Model) -> Model:
    """``rounds`` rounds over all rows of ``encoded`` (symbols)."""
    k, n = len(model.start), len(prior)
    sc = encoded.sparkSession.sparkContext
    names = [f"s{i}" for i in range(k)]
    schema = "symbol int, " + ", ".join(f"{x} double" for x in names)
    for _ in range(rounds):
        shared = sc.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            model = shared.value
            states, moves, start = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
            for pdf in batches:
                for seqs in _side_by_side(list(pdf["symbols"])):
                    for own, s, m, a in expected_whole(model, seqs):
                        states[own] += s
                        moves += m
                        start += a
            met = np.flatnonzero(states.any(axis=1))
            rows = np.concatenate([states[met], moves, start[None]])
            yield pd.DataFrame(rows, columns=names).assign(symbol=np.concatenate([met, -1 - np.arange(k), [-1 - k]]).astype(np.int32))[["symbol", *names]]

        got = mapped(encoded.select("symbols"), run, schema).groupBy("symbol").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
        if not len(got):
            return model
        values, at = got[names].to_numpy(), got["symbol"].to_numpy()
        states = np.zeros((n, k))
        states[at[at >= 0]] = values[at >= 0]
        moves = np.zeros((k, k))
        inner = (at < 0) & (at >= -k)
        moves[-1 - at[inner]] = values[inner]
        model = maximized(states, moves, values[at == -1 - k][0], prior)
    return model


def dealt_runs(encoded: DataFrame, weights: np.ndarray, cut: int = CUT) -> np.ndarray:
    """Symbols x states: how often each symbol stands in the runs of each state, over all rows of ``encoded``.

    Each text is cut into runs of ``cut`` symbols, all of which count; a run's state is the one whose ``weights`` (symbols x states) sum highest over it, the first of equal ones.
    """
    n, k = weights.shape
    shared = encoded.sparkSession.sparkContext.broadcast(weights)
    names = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(n * k, dtype=np.int64)
        for pdf in batches:
            raw = list(pdf["symbols"])
            for part in cuts_of(raw, 500_000):
                size = np.array([len(r) // 2 for r in raw[part]])
                flat = np.frombuffer(b"".join(raw[part]), dtype="<u2").astype(np.int64)
                if not len(flat):
                    continue
                runs = -(-size // cut)
                first = np.repeat(np.cumsum(size) - size, runs) + cut * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
                best = np.add.reduceat(shared.value[flat], first, axis=0).argmax(axis=1)
                counts += np.bincount(flat * k + np.repeat(best, np.diff(np.append(first, len(flat)))), minlength=n * k)
        table = counts.reshape(n, k)
        met = np.flatnonzero(table.any(axis=1))
        yield pd.DataFrame(table[met], columns=names).assign(symbol=met.astype(np.int32))[["symbol", *names]]

    got = mapped(encoded.select("symbols"), run, "symbol int, " + ", ".join(f"{x} long" for x in names)).groupBy("symbol").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    out = np.zeros((n, k))
    out[got["symbol"].to_numpy(np.int64)] = got[names].to_numpy(np.float64)
    return out


def seeded(encoded: DataFrame, prior: np.ndarray, states: int, rounds: int, seed: int = 11) -> Model:
    """A first model from all rows of ``encoded``: the largest states are halved by random weights of symbols until there are ``states``.

    After each halving, runs are dealt to the state whose symbols they hold more of than chance gives, ``rounds`` times more; SHRUNK counts a symbol keep rare ones from deciding.
    """
    rng = np.random.default_rng(seed)
    weights, share = np.zeros((len(prior), 1)), np.ones(1)
    counts = prior[:, None]
    while weights.shape[1] < states:
        most = np.argsort(-share, kind="stable")[: states - weights.shape[1]]
        draws = rng.normal(size=(len(prior), len(most)))
        draws = 0.3 * (draws - prior @ draws)
        other = weights[:, most] - draws
        weights[:, most] += draws
        weights = np.append(weights, other, axis=1)
        for _ in range(rounds + 1):
            counts = dealt_runs(encoded, weights.astype(np.float32)) + 1e-9
            share = counts.sum(axis=0) / counts.sum()
            weights = np.log((counts + SHRUNK * share) / (share * (counts.sum(axis=1, keepdims=True) + SHRUNK)))
    moves = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(moves, 0.95 if states > 1 else 1.0)
    start = np.full(states, 1 / states)
    return Model(start, moves, maximized(counts, moves, start, prior).emit)


def forward(model: Model, raw: list[bytes]) -> np.ndarray:
    """log10 probability of each symbol sequence, in full length."""
    seqs = [np.frombuffer(r, dtype="<u2").astype(np.int64) for r in raw]
    out = np.zeros(len(seqs))
    n = np.array([len(s) for s in seqs])
    order = np.argsort(-n, kind="stable")
    n = n[order]
    flat = np.concatenate([seqs[i] for i in order]) if len(seqs) else np.zeros(0, dtype=np.int64)
    first = np.cumsum(n) - n
    a, total = None, np.zeros(len(seqs))
    for t in range(n[0] if len(n) else 0):
        m = int(np.searchsorted(-n, -t, side="left"))  # those longer than t
        e = model.emit[flat[first[:m] + t]]
        a = (model.start * e) if t == 0 else (a[:m] @ model.moves) * e
        s = a.sum(axis=1)
        total[:m] += np.log(s)
        a = a / s[:, None]
    out[order] = total / LOG10
    return out


def language_model_scores(docs: DataFrame, learn: Column, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """doc_id, held_out (not ``learn``), n_tokens, n_known, train_tokens, base_score and score of each row.

    Null is the empty text, whose one token is the end. A null ``learn`` counts as held out. Repeated rows
    count and are scored each. Without training rows every token is unknown and the model is uniform.
    Other columns are not read.
    """
    rows = docs.select("doc_id", "text", (~F.coalesce(learn, F.lit(False))).alias("held_out"))
    counts = written(token_counts(rows.where("not held_out")), "token-counts")
    vocab = vocabulary(counts)
    encoded = written(encode(rows.withColumn("row", F.monotonically_increasing_id()), vocab), "encoded")
    mass = np.zeros(SYMBOLS + CLASSES)
    kept = min(SYMBOLS, len(vocab.counts))
    mass[:kept] = vocab.counts[:kept]
    mass[SYMBOLS:] = vocab.class_total  # c + 1 of its tokens, and 1 for what none has seen
    mass[:SYMBOLS] = np.where(mass[:SYMBOLS] > 0, mass[:SYMBOLS], 0)
    prior = mass / mass.sum()
    trained = encoded.where("not held_out").select("symbols")
    model = seeded(trained, prior, states, SEED_ROUNDS)
    model = baum_welch(trained, prior, rounds, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", "row", "held_out", "n_tokens", "known", "base", "rare"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[columns].assign(forward=forward(shared.value, list(pdf["symbols"])))

    scored = encoded.select(*columns, "symbols")
    scored = mapped(scored, run, scored.drop("symbols").withColumn("forward", F.lit(0.0)).schema)
    beyond = encoded.where(F.size("tail") > 0).select("row", F.explode(F.arrays_zip("tail", "tail_class")).alias("x"))
    log_z = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(vocab.class_total)]), F.col("x.tail_class") + 1)
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    tails = (
        beyond.withColumn("token", F.col("x.tail"))
        .join(counts, "token", "left")
        .groupBy("row")
        .agg(
            F.sum(log_c).alias("tail_base"),
            F.sum(log_c - log_z).alias("tail_rare"),
            F.count("c").alias("tail_known"),
        )
    )
    zero = F.lit(0.0)
    return scored.join(tails, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero) - F.col("n_tokens") * F.lit(float(vocab.base))).alias("base_score"),
        (F.col("forward") + F.col("rare") + F.coalesce("tail_rare", zero)).alias("score"),
    )


def op7_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts, learned from those outside the held-out seventh. A null text has the end token only; more as ``language_model_scores`` says."""
    return language_model_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)


QUERIES = {"op7_hidden_markov_lm": op7_hidden_markov_lm}
ORACLE: dict[str, str] = {}
