"""Mixture-controlled packing by deficit round-robin (operator 1).

Each source is a queue of tokens. A window of ``window_tokens`` is filled in
one round: every queue adds its quantum (its target share of the window) to
its deficit counter and is served the whole tokens in it; the fraction stays
as the deficit with which it enters the next window. So the tokens that a queue
has been served after window w are the whole part of its quanta so far - a
number that every partition can compute for every window from the queues'
totals alone, which is how deficits are carried across partitions without
passing state. When a queue runs dry, the others share its quantum by weight.

The windows, one after another, are one stream of tokens without gaps, cut
into sequences; only the last sequence can be short.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from dendrospark.llm.common import cuts_of, mapped, small, table, written
from dendrospark.operators.windows import dense_rank_over_all

SEQUENCE, WINDOW_SEQUENCES, MAX_QUEUES, END_ID = 1024, 64, 1024, 0
#: The mixture of the query: the largest source at four times the share of each other one, wherever both have tokens left.
MIXTURE, OTHERS = {"src0": 4.0}, 1.0


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] places), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class WordTokenizer:
    """Ids of whole texts, with a bounded cache of what stands between spaces.

    The tokenizer's own first step begins a piece at each space that a
    non-space follows, so the ids of a text are those of its parts cut there.
    """

    def __init__(self, path: str, cache: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        size = self.model.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.opens = np.array([(self.model.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.limit = cache
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.kind)
        self.strange = np.zeros(0, dtype=bool)  # what stands after a space that doesn't begin a word

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids = [np.array(x.ids, dtype=self.kind) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype=self.kind), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        flat, size = [self.flat], [self.size]
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = self.whole([" " + " ".join(part)])[0]
            cut = np.flatnonzero(self.opens[ids])
            n = np.diff(np.append(cut, len(ids)))
            if len(cut) != len(part):  # a word with a space inside can't come here; be safe
                ids, n = self.whole([" " + w for w in part])
            flat.append(ids)
            size.append(n)
        self.strange = np.append(self.strange, np.array([not w or w[0].isspace() for w in words], dtype=bool))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        self.first = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``end``, and how many each has."""
        cuts = [t.partition(" ") for t in texts]
        heads = [c[0] for c in cuts]
        parts = pc.split_pattern(pa.array([c[2] if c[1] else None for c in cuts], pa.large_string()), " ")
        many = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = parts.flatten().dictionary_encode()
        own, at = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > self.limit:
            self._forget()
        self._learn([w for w in own if w not in self.known])
        number = np.array([*map(self.known.__getitem__, own)], dtype=np.int64)[at]
        met, ends = np.append(0, np.cumsum(self.strange[number])), np.cumsum(many)
        odd = met[ends] > met[ends - many]
        if odd.any():
            number = number[np.repeat(~odd, many)]
            many = np.where(odd, 0, many)
            heads = [t if o else h for t, h, o in zip(texts, heads, odd)]
        n = self.size[number]
        by_text = np.append(0, np.cumsum(n))[np.cumsum(many)]
        head_ids, head_n = self.whole(heads)
        in_words = np.diff(by_text, prepend=0)
        total = head_n + in_words + 1
        begin = np.cumsum(total) - total
        out = np.full(int(total.sum()), end, dtype=self.kind)
        out[_spread(begin, head_n)] = head_ids
        out[_spread(begin + head_n, in_words)] = self.flat[_spread(self.first[number], n)]
        return out, total


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize(docs: DataFrame, tokenizer: str, queues: list[str | None] | None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: its queue, its ids (with the end id) and its start in its partition's part of the queue.

    ``queues``: the sources by number; where None, the queue is the source itself.
    """
    number = None if queues is None else {q: i for i, q in enumerate(queues)}
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("chunk", T.IntegerType()), T.StructField("queue", T.StringType() if queues is None else T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "n")]
        + [T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, chunk, served = _tokenizer(tokenizer), TaskContext.get().partitionId(), {}
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            for part in cuts_of(texts):
                ids, n = words.encode(texts[part], END_ID)
                names = [None if s is None else s for s in pdf["source"].iloc[part]]
                qs = names if number is None else [number[s] for s in names]
                starts, cuts = [], np.cumsum(n).tolist()
                for q, m in zip(qs, n.tolist()):
                    starts.append(served.get(q, 0))
                    served[q] = starts[-1] + m
                raw = [ids[a:b].tobytes() for a, b in zip([0, *cuts], cuts)]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[part], "chunk": chunk, "queue": qs, "start": starts, "n": n, "ids": raw})

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    return mapped(picked, run, schema)


class Rounds:
    """What a queue has been served after each window, from its own total and weight and the curve of all queues.

    ``dry``: distinct rounds at which queues run dry, with the tokens and weights of those that do (bounded by the
    different totals, not by the queues). ``rest``: tokens of the queues of weight 0, which come when all others are dry,
    by their shares; here their weight is their total, negative.
    """

    def __init__(self, dry: list[tuple[float, int, float]], rest: int, window_tokens: int):
        dry = sorted(dry)
        r, n, w = (np.array([x[i] for x in dry], dtype=float) for i in range(3))
        self.window, self.total = window_tokens, int(sum(x[1] for x in dry)) + rest
        self.windows = max(1, -(-self.total // window_tokens))
        gone, live = np.cumsum(n), w.sum() - np.cumsum(w)
        self.rounds, self.at = np.append(0.0, r), np.append(0.0, gone + np.maximum(live, 0) * r)
        self.at[-1], self.last = self.total - rest, float(self.rounds[-1])
        if rest:
            self.rounds, self.at = np.append(self.rounds, self.last + 1), np.append(self.at, self.total)

    @classmethod
    def of(cls, totals: np.ndarray, weights: np.ndarray, window_tokens: int) -> Rounds:
        first = weights > 0
        dry = [(n / w, int(n), w) for n, w in zip(totals[first].tolist(), weights[first].tolist())]
        return cls(dry, int(totals[~first].sum()), window_tokens)

    def served(self, total: np.ndarray, weight: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Tokens of each queue in the windows before ``window``."""
        rounds = np.interp(np.minimum(window * float(self.window), self.total), self.at, self.rounds)
        rounds = np.where(weight > 0, rounds, np.maximum(rounds - self.last, 0))
        now = np.minimum(total, np.floor(np.abs(weight) * rounds * (1 + 1e-15)).astype(np.int64))
        return np.where(window >= self.windows, total, np.where(window <= 0, 0, now))

    def window_of(self, total: np.ndarray, weight: np.ndarray, token: np.ndarray) -> np.ndarray:
        rounds = token / np.abs(weight) + np.where(weight > 0, 0, self.last)
        w = (np.interp(rounds, self.rounds, self.at) / self.window).astype(np.int64).clip(0, self.windows - 1)
        while (high := self.served(total, weight, w) > token).any():
            w -= high
        while (low := self.served(total, weight, w + 1) <= token).any():
            w += low
        return w

    def split(self, total: np.ndarray, weight: np.ndarray, start: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Token runs cut by windows: of which run, its window, and the tokens [low, high) of its queue."""
        first, last = self.window_of(total, weight, start), self.window_of(total, weight, start + n - 1)
        many = last - first + 1
        run = np.repeat(np.arange(len(n)), many)
        w = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        low = np.maximum(start[run], self.served(total[run], weight[run], w))
        high = np.minimum(start[run] + n[run], self.served(total[run], weight[run], w + 1))
        run, w, low, high = (x[high > low] for x in (run, w, low, high))
        return {"run": run, "window": w, "low": low, "high": high}


def _pack_many(docs: DataFrame, tokenizer: str, targets: dict[str | None, float] | None, others: float, sequence: int, window_sequences: int, doc_id: str, text: str, source: str) -> DataFrame:
    """``pack`` where queues are too many for one task: a queue's total and weight travel with its rows, and the tokens that
    other queues have before it in a window are summed over a table of queues and windows, which has no more rows than the result."""
    tokens = written(tokenize(docs, tokenizer, None, doc_id, text, source).withColumnRenamed("queue", "source"), "tokens")
    parts = written(tokens.groupBy("source", "chunk").agg(F.sum("n").alias("n")), "token-parts")
    own = parts.groupBy("source").agg(F.sum("n").alias("total"))
    if targets is None:
        own = own.withColumn("weight", F.col("total").cast("double"))
    else:
        want = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "of string, weight double")
        own = own.join(want, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").fillna(others, "weight")
        own = own.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(-F.col("total").cast("double")))
    own = dense_rank_over_all(own, [F.col("source").isNotNull(), F.col("source")], "queue")
    own = written(own.withColumn("queue", (F.col("queue") - 1).cast("int")), "token-queues")
    curve = own.where("weight > 0").groupBy((F.col("total") / F.col("weight")).alias("r")).agg(F.sum("total").alias("n"), F.sum("weight").alias("w")).collect()
    rest = own.where("weight < 0").agg(F.sum("total")).first()[0] or 0
    plan = Rounds([tuple(x) for x in curve], rest, sequence * window_sequences)
    before = W.Window.partitionBy("source").orderBy("chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    base = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    base = base.join(own, base["source"].eqNullSafe(own["source"])).select(base["source"], "chunk", "base", "queue", "total", "weight")
    base = written(base, "token-bases")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(q: np.ndarray, total: np.ndarray, weight: np.ndarray, w: np.ndarray) -> pd.DataFrame:
            a, b = plan.served(total, weight, w), plan.served(total, weight, w + 1)
            return pd.DataFrame({"queue": q, "window": w, "low_q": a, "count": b - a})[b > a]

        for pdf in batches:
            short = pdf[pdf["total"] <= plan.windows]  # by token, the others by window: as many steps as rows, about
            for _, part in short.groupby((short["total"].cumsum() - 1) // (1 << 20)):
                many = part["total"].to_numpy(np.int64)
                run = np.repeat(np.arange(len(many)), many)
                token = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
                q, weight = part["queue"].to_numpy()[run], part["weight"].to_numpy(float)[run]
                w = plan.window_of(many[run], weight, token)
                new = np.append(True, (q[1:] != q[:-1]) | (w[1:] != w[:-1]))
                yield made(q[new], many[run][new], weight[new], w[new])
            for q, total, weight in pdf.loc[pdf["total"] > plan.windows, ["queue", "total", "weight"]].itertuples(index=False):
                for at in range(0, plan.windows, 1 << 16):
                    w = np.arange(at, min(plan.windows, at + (1 << 16)))
                    yield made(np.full(len(w), q), np.full(len(w), total), np.full(len(w), weight), w)

    each = written(mapped(own.select("queue", "total", "weight"), cells, "queue int, window long, low_q long, count long"), "token-cells")
    windows = each.groupBy("window").agg(F.sum("count").alias("count"))
    ends = W.Window.orderBy("window").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a window
    begin = windows.select("window", F.coalesce(F.sum("count").over(ends), F.lit(0)).alias("begin"))
    ahead = W.Window.partitionBy("window").orderBy("queue").rowsBetween(W.Window.unboundedPreceding, -1)
    placed = each.withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).join(begin, "window")
    placed = written(placed.select("queue", "window", (F.col("begin") + F.col("ahead") - F.col("low_q")).alias("shift")), "token-places")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for part in cuts_of([x[::2] for x in whole["ids"]], 2_000_000):
                pdf = whole.iloc[part]
                n, first = pdf["n"].to_numpy(np.int64), (pdf["start"] + pdf["base"]).to_numpy(np.int64)
                got = plan.split(pdf["total"].to_numpy(np.int64), pdf["weight"].to_numpy(float), first, n)
                wide = [np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * m else "<u4").astype("<u4").tobytes() for raw, m in zip(pdf["ids"], n)]
                run, start = got["run"], got["low"] - first[got["run"]]
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].take(run).reset_index(drop=True), "queue": pdf["queue"].to_numpy()[run], "window": got["window"],
                        "low": got["low"], "start": start, "doc_tokens": n[run],
                        "ids": [wide[i][4 * s : 4 * (s + k)] for i, s, k in zip(run.tolist(), start.tolist(), (got["high"] - got["low"]).tolist())],
                    }
                )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            place, size = (pdf["shift"] + pdf["low"]).to_numpy(np.int64), np.array([len(x) // 4 for x in pdf["ids"]], dtype=np.int64)
            many = (place + size - 1) // sequence - place // sequence + 1
            run = np.repeat(np.arange(len(size)), many)
            step = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
            begin = np.maximum(place[run], (place[run] // sequence + step) * sequence)
            end = np.minimum(place[run] + size[run], (begin // sequence + 1) * sequence)
            raw = pdf["ids"].tolist()
            ids = [raw[i][4 * a : 4 * b] for i, a, b in zip(run.tolist(), (begin - place[run]).tolist(), (end - place[run]).tolist())]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].take(run).reset_index(drop=True), "start": pdf["start"].to_numpy()[run] + begin - place[run], "length": end - begin,
                    "ids_crc32": [zlib.crc32(x) for x in ids], "doc_tokens": pdf["doc_tokens"].to_numpy()[run], "sequence_id": begin // sequence, "offset": begin % sequence,
                    "window": pdf["window"].to_numpy()[run], "queue": pdf["queue"].to_numpy()[run], "ids": ids,
                }
            )

    id_field = tokens.schema["doc_id"]
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    queue, ids = T.StructField("queue", T.IntegerType()), T.StructField("ids", T.BinaryType())
    based = base.withColumnRenamed("source", "of").withColumnRenamed("chunk", "at")
    runs = tokens.join(based, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at"))).drop("of", "at", "source")
    pieces = mapped(runs, split, T.StructType([id_field, queue, *longs("window", "low", "start", "doc_tokens"), ids]))
    schema = T.StructType([id_field, *longs("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"), queue, ids])
    return mapped(pieces.join(placed, ["queue", "window"]), cut, schema)


class Schedule:
    """The pieces of all queues' tokens in the stream of windows."""

    def __init__(self, totals: list[int], weights: list[float], window_tokens: int):
        self.totals, self.weights = np.array(totals, dtype=np.int64), np.array(weights, dtype=float)
        self.plan = Rounds.of(self.totals, self.weights, window_tokens)

    def before(self, window: np.ndarray) -> np.ndarray:
        """Tokens in the windows before ``window``, a row for each queue."""
        return np.stack([self.plan.served(n, w, window) for n, w in zip(self.totals, self.weights)])

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray, sequence: int) -> dict[str, np.ndarray]:
        """The pieces of token runs: of which run, its first token in it, its length, window and place in the stream."""
        got = self.plan.split(self.totals[queue], self.weights[queue], start, n)
        run, w, low, high = got["run"], got["window"], got["low"], got["high"]
        q = queue[run]
        own, at = np.unique(w, return_inverse=True)
        here, after = self.before(own), self.before(own + 1)
        ahead = np.cumsum(after - here, axis=0) - (after - here)
        place = here.sum(axis=0)[at] + ahead[q, at] + low - here[q, at]
        cuts = (place + high - low - 1) // sequence - place // sequence + 1
        piece = np.repeat(np.arange(len(run)), cuts)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.maximum(place[piece], (place[piece] // sequence + step) * sequence)
        end = np.minimum(place[piece] + (high - low)[piece], (begin // sequence + 1) * sequence)
        inside = low[piece] - start[run[piece]] + begin - place[piece]
        return {"run": run[piece], "start": inside, "length": end - begin, "window": w[piece], "place": begin}


def pack(
    docs: DataFrame,
    tokenizer: str,
    targets: dict[str | None, float] | None = None,
    others: float | None = None,
    sequence: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Pieces of every document in packed sequences, with the ids of each piece (``ids``: little-endian uint32).

    ``targets``: weight of each source in every window (default: its share of all tokens, with
    which all queues end together); ``others``: weight of sources that aren't in it (default: the smallest one given).
    A source of weight 0 comes when all others are dry; a negative weight is an error.
    A null text is empty; an empty text is the end id alone. Null sources are one queue. Beyond
    MAX_QUEUES sources, the queues are a distributed table (``_pack_many``), with the same results.
    Repeated rows are packed each. An empty table gives no rows.
    Columns other than the three named are not read.
    """
    if targets is not None:
        others = min(targets.values(), default=1.0) if others is None else others
        if not all(0 <= w < float("inf") for w in (others, *targets.values())):
            raise ValueError("weights must be numbers from 0 on")
    named = [r[0] for r in docs.select(F.col(source).cast("string")).distinct().limit(MAX_QUEUES + 1).collect()]
    queues = sorted(named, key=lambda s: (s is not None, s)) if len(named) <= MAX_QUEUES else None
    if queues is None:
        return _pack_many(docs, tokenizer, targets, others, sequence, window_sequences, doc_id, text, source)
    tokens = written(tokenize(docs, tokenizer, queues, doc_id, text, source), "tokens")
    parts = written(tokens.groupBy("queue", "chunk").agg(F.sum("n").alias("n")), "token-parts")
    before = W.Window.partitionBy("queue").orderBy("chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    base = parts.select("queue", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sums = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # MAX_QUEUES rows at most
    numbers = sorted(sums)
    dense = {q: i for i, q in enumerate(numbers)}
    weights = [float(sums[q] if targets is None else targets.get(queues[q], others) or -sums[q]) for q in numbers]
    plan = Schedule([sums[q] for q in numbers], weights, sequence * window_sequences) if sums else None
    schema = T.StructType(
        [tokens.schema["doc_id"]]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window")]
        + [T.StructField("queue", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for part in cuts_of([x[::2] for x in whole["ids"]], 2_000_000):
                pdf = whole.iloc[part]
                q = pdf["queue"].map(dense).to_numpy(np.int64)
                n = pdf["n"].to_numpy(np.int64)
                got = plan.pieces(q, (pdf["start"] + pdf["base"]).to_numpy(np.int64), n, sequence)
                wide = []
                for raw, m in zip(pdf["ids"], n):
                    wide.append(np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * m else "<u4").astype("<u4").tobytes())
                r, a, m = got["run"].tolist(), got["start"].tolist(), got["length"].tolist()
                ids = [wide[i][4 * s : 4 * (s + k)] for i, s, k in zip(r, a, m)]
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].take(got["run"]).reset_index(drop=True),
                        "start": got["start"],
                        "length": got["length"],
                        "ids_crc32": [zlib.crc32(x) for x in ids],
                        "doc_tokens": n[got["run"]],
                        "sequence_id": got["place"] // sequence,
                        "offset": got["place"] % sequence,
                        "window": got["window"],
                        "queue": pdf["queue"].to_numpy()[got["run"]],
                        "ids": ids,
                    }
                )

    return mapped(tokens.join(small(base), ["queue", "chunk"]), run, schema)


def packed_digest(docs: DataFrame, tokenizer: str, targets: dict[str | None, float] | None = None, others: float | None = None) -> DataFrame:
    """``pack`` without the ids; nulls, empty texts, ties and repeats as it says."""
    return pack(docs, tokenizer, targets, others).drop("ids")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as ``pack`` does, mixed by MIXTURE and OTHERS."""
    import public_tokenizers

    return packed_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), MIXTURE, OTHERS)


QUERIES = {"op1_mixture_packing": op1_mixture_packing}
ORACLE: dict[str, str] = {}
