"""Ranked lexical search over a length-stratified index (operator 13).

Documents with an equal length normaliser m are a stratum. A row of the index is a stratum, or a piece of one that has many postings:
its documents and, by term and within it by tf, their places. So what an occurrence is worth is computed once
for each (term, tf), and a stratum's largest tf of each term gives a bound of what any of its documents can score.
Tasks read index rows where they lie and visit, for each query, those rows whose bound reaches the score to beat, the largest bounds first.
A first visit of each task's best row sets that score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from dendrospark.llm.common import UPPER, lower_ascii, mapped, small, table, whole_groups, written

TOP = 10
#: Query terms of at most this many bytes in all go to every task, which then counts these terms only; beyond, all terms are counted and joined.
TERMS_BYTES = 16 << 20
#: Postings that a row of the index holds before a stratum is cut into pieces.
PIECE = 1 << 17
#: Queries in a block, and cells (queries times documents) of scores at a time.
QUERIES_A_BLOCK, CELLS = 256, 4_000_000
#: Query blocks of at most this many bytes go to every task; beyond, they meet shelves of so many index rows by a shuffle.
BROADCAST_BYTES, SHELF_ROWS = 64 << 20, 256
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over UTF-8 bytes, A-Z in lower case.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def counted(text: str | None) -> Counter:
    """How often each term (UTF-8) occurs in a text."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) < 4_000_000:
        return Counter(TERM.findall(data))
    return Counter(m.group() for m in TERM.finditer(data))


def term_counts(docs: DataFrame, terms: DataFrame, terms_bytes: int = TERMS_BYTES) -> DataFrame:
    """(row, doc_id, n, tids, tfs) of the documents with a term: of ``terms`` (tid, term), those that each holds, with their occurrences."""
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    known = None
    if size <= terms_bytes:
        known = docs.sparkSession.sparkContext.broadcast({r["term"].encode("utf-8", "surrogatepass"): r["tid"] for r in terms.collect()})
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tid_of = known.value if known else None
        for pdf in batches:
            n, keys, tfs = [], [], []
            for t in pdf["text"]:
                c = counted(t)
                n.append(c.total())
                if tid_of is None:
                    keys.append([k.decode("utf-8", "surrogatepass") for k in c])
                    tfs.append(list(c.values()))
                else:
                    own = [(tid_of[k], v) for k, v in c.items() if k in tid_of]
                    keys.append([k for k, _ in own])
                    tfs.append([v for _, v in own])
            out = pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "n": n, "tids": keys, "tfs": tfs})
            yield out[out["n"] > 0]

    schema = rows.select("row", "doc_id", F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long") if known else F.lit("")).alias("tids"), F.array(F.lit(0).cast("long")).alias("tfs")).schema
    got = written(mapped(rows, run, schema), "term-counts")
    if known:
        return got
    each = got.select("row", F.explode(F.arrays_zip("tids", "tfs")).alias("x")).select("row", F.col("x.tids").alias("term"), F.col("x.tfs").alias("tf")).join(terms, "term")
    own = each.groupBy("row").agg(F.collect_list(F.struct("tid", "tf")).alias("x"))
    pick = lambda c: F.coalesce(F.transform("x", lambda p: p[c]), F.array().cast("array<long>"))
    return written(got.select("row", "doc_id", "n").join(own, "row", "left").select("row", "doc_id", "n", pick("tid").alias("tids"), pick("tf").alias("tfs")), "term-counts")


def built_index(counts: DataFrame, documents: int, occurrences: int, piece: int = PIECE) -> DataFrame:
    """The index of ``counts`` for N = ``documents`` and L = ``occurrences``: m, piece, docs, known, tid, tf, many, places (numpy arrays as bytes)."""
    counts = counts.withColumn("m", F.lit(100 - 90) + F.expr(f"(90 * n * {documents}L) div {occurrences}L"))
    strata = counts.groupBy("m").agg(F.ceil(F.sum(F.size("tids")) / piece).cast("long").alias("pieces")).where("pieces > 1")
    rows = counts.join(small(written(strata, "large-strata")), "m", "left")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1)))).select("m", "piece", "doc_id", "tids", "tfs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "m", "piece"):
            m, p = pdf["m"].to_numpy(), pdf["piece"].to_numpy()
            cut = np.append(np.append(0, np.flatnonzero((m[1:] != m[:-1]) | (p[1:] != p[:-1])) + 1), len(pdf))
            sizes = pdf["tids"].map(len).to_numpy()
            ends = np.append(0, np.cumsum(sizes))
            tid, tf = (np.concatenate([np.empty(0, dtype=np.int64), *pdf[c]]).astype(np.int64) for c in ("tids", "tfs"))
            known = pdf["doc_id"].notna().to_numpy()
            ids = pdf["doc_id"].fillna(0).astype(np.int64).to_numpy()
            out = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                t, f, at = tid[ends[a] : ends[b]], tf[ends[a] : ends[b]], np.repeat(np.arange(b - a, dtype=np.int32), sizes[a:b])
                order = np.lexsort((f, t))
                t, f, at = t[order], f[order], at[order]
                first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (f[1:] != f[:-1]))) if len(t) else np.empty(0, dtype=np.int64)
                many = np.diff(np.append(first, len(t)))
                out.append((m[a], p[a], ids[a:b].tobytes(), known[a:b].tobytes(), t[first].tobytes(), f[first].tobytes(), many.astype(np.int64).tobytes(), at.tobytes()))
            yield pd.DataFrame(out, columns=["m", "piece", "docs", "known", "tid", "tf", "many", "places"])

    spread = rows.repartition("m", "piece").sortWithinPartitions("m", "piece")
    return written(mapped(spread, run, "m long, piece long, docs binary, known binary, tid binary, tf binary, many binary, places binary"), "lexical-index")


class Rows:
    """Some rows of the index, put together: entries (row, tid, tf, where their places are) and documents."""

    def __init__(self, pdf: pd.DataFrame):
        def flat(c: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
            parts = [np.frombuffer(x, dtype=kind) for x in pdf[c]]
            return np.concatenate(parts), np.array([len(x) for x in parts])

        self.ids, docs = flat("docs", np.int64)
        self.known = flat("known", bool)[0]
        self.tid, entries = flat("tid", np.int64)
        self.tf, self.many = flat("tf", np.int64)[0], flat("many", np.int64)[0]
        self.places, postings = flat("places", np.int32)
        self.docs, self.postings = docs, postings
        self.base = np.cumsum(docs) - docs
        self.row = np.repeat(np.arange(len(pdf)), entries)
        self.at = np.cumsum(self.many) - self.many
        m = pdf["m"].to_numpy()[self.row]
        self.impact = (1_000_000_000 * self.tf) // (1000 * self.tf + 8 * m)  # once for each (stratum, term, tf)
        last = np.append((self.tid[1:] != self.tid[:-1]) | (self.row[1:] != self.row[:-1]), True) if len(self.tid) else np.empty(0, dtype=bool)
        self.largest = np.flatnonzero(last)  # impacts grow with tf


def _met(tids: np.ndarray, q_tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (entry, query term) of equal tids; ``q_tid`` is sorted."""
    low, high = np.searchsorted(q_tid, tids, "left"), np.searchsorted(q_tid, tids, "right")
    n = high - low
    entry = np.repeat(np.arange(len(tids)), n)
    return entry, np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(entry)) if len(entry) else entry


def _sums(cell: np.ndarray, value: np.ndarray, n: int, large: bool) -> np.ndarray:
    """Sums of whole numbers by cell. As doubles they are exact unless ``large``."""
    if not large:
        return np.bincount(cell, value, n).astype(np.int64)
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, cell, value)
    return out


def bounds(rows: Rows, n_rows: int, q: np.ndarray, q_tid: np.ndarray, w: np.ndarray, queries: int) -> np.ndarray:
    """What a document in each index row (first axis) can score at most for each query."""
    e, k = _met(rows.tid[rows.largest], q_tid)
    e = rows.largest[e]
    return _sums(rows.row[e] * queries + q[k], rows.impact[e] * w[k], n_rows * queries, True).reshape(n_rows, queries)


def scores(rows: Rows, wanted: np.ndarray, chosen: np.ndarray, q: np.ndarray, q_tid: np.ndarray, w: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray]:
    """For index rows ``chosen``: (their documents' places, scores by query and document). ``wanted``: whether a query visits a row."""
    use = np.flatnonzero(np.isin(rows.row, chosen))
    e, k = _met(rows.tid[use], q_tid)
    e = use[e]
    stay = wanted[rows.row[e], q[k]]
    e, k = e[stay], k[stay]
    docs = np.concatenate([np.arange(rows.base[r], rows.base[r] + rows.docs[r]) for r in chosen])
    new = np.zeros(wanted.shape[0], dtype=np.int64)
    new[chosen] = np.cumsum(rows.docs[chosen]) - rows.docs[chosen]
    n = rows.many[e]
    pair = np.repeat(np.arange(len(e)), n)
    posting = np.repeat(rows.at[e] - (np.cumsum(n) - n), n) + np.arange(len(pair))
    doc = new[rows.row[e]][pair] + rows.places[posting]
    out = _sums(q[k][pair] * len(docs) + doc, (rows.impact[e] * w[k])[pair], wanted.shape[1] * len(docs), large)
    return docs, out.reshape(wanted.shape[1], len(docs))


def visited(pairs: DataFrame, top: int, first_only: bool) -> DataFrame:
    """(query, row number of results) q, doc_id, score: the best documents of each task's index rows, for the queries of the blocks that they meet.

    With ``first_only`` each query visits only the row of a batch with its largest bound.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, own in pdf.groupby("block"):
                first = own.iloc[0]
                ids, q, q_tid, w = (np.frombuffer(first[c], dtype=np.int64) for c in ("ids", "q", "q_tid", "w"))
                floor = floors.setdefault(int(block), np.frombuffer(first["floor"], dtype=np.int64).copy())
                rows = Rows(own)
                most = bounds(rows, len(own), q, q_tid, w, len(ids))
                if first_only:
                    wanted = np.zeros_like(most, dtype=bool)
                    wanted[most.argmax(axis=0), np.arange(len(ids))] = True
                    wanted &= most > 0
                else:
                    wanted = (most > 0) & (most >= floor)
                order = np.argsort(-np.where(wanted, most, -1).max(axis=1), kind="stable")
                order = order[wanted[order].any(axis=1)]
                while len(order):
                    size = np.cumsum(rows.docs[order]) * len(ids)
                    n = max(1, int(np.searchsorted(size, CELLS, "right")))
                    chosen, order = np.sort(order[:n]), order[n:]
                    docs, score = scores(rows, wanted, chosen, q, q_tid, w, int(most.max()) >= 1 << 53)
                    for i in np.flatnonzero(score.max(axis=1) > 0).tolist():
                        s = score[i]
                        least = max(1, int(floor[i]))
                        if len(s) > top:
                            least = max(least, int(np.partition(s, len(s) - top)[len(s) - top]))
                        at = np.flatnonzero(s >= least)
                        if not len(at):
                            continue
                        at = at[np.lexsort((rows.ids[docs[at]], ~rows.known[docs[at]], -s[at]))[:top]]
                        if len(at) == top:
                            floor[i] = max(floor[i], s[at[-1]])
                        yield pd.DataFrame({"q": ids[i], "doc_id": pd.Series(rows.ids[docs[at]]).astype("Int64").mask(~rows.known[docs[at]]), "score": s[at]})
                    if not first_only:
                        wanted &= most >= floor
                        order = order[wanted[order].any(axis=1)]

    return mapped(pairs, run, "q long, doc_id long, score long")


def _met_blocks(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """Index rows with each query block: blocks go to every task if they are few, else shelves of index rows get a copy each."""
    size = blocks.agg(F.sum(F.length("ids") + F.length("q") * 3 + F.length("floor"))).first()[0] or 0
    shelves = 1 if size <= BROADCAST_BYTES else -(-index.count() // SHELF_ROWS)
    left = index.withColumn("shelf", F.pmod(F.xxhash64("m", "piece"), F.lit(shelves)))
    right = blocks.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1)))).withColumn("shelf", F.col("shelf").cast("long"))
    right = F.broadcast(right) if shelves == 1 else right.hint("merge")
    return left.join(right, "shelf").drop("shelf")


def _blocks(words: DataFrame, queries: int) -> DataFrame:
    """Query terms (q, tid, w) as blocks: ids of queries and, sorted by tid, (query's place, tid, w)."""
    n = max(1, -(-queries // QUERIES_A_BLOCK))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "block"):
            for block, own in frame.groupby("block"):
                own = own.sort_values("tid", kind="stable")
                ids, place = np.unique(own["q"].to_numpy(np.int64), return_inverse=True)
                arrays = [ids, place, own["tid"].to_numpy(), own["w"].to_numpy(), np.zeros(len(ids))]
                yield pd.DataFrame([[block, *[x.astype(np.int64).tobytes() for x in arrays]]], columns=["block", "ids", "q", "q_tid", "w", "floor"])

    spread = words.select(F.pmod(F.xxhash64("q"), F.lit(n)).alias("block"), "q", "tid", "w").repartition("block").sortWithinPartitions("block")
    return written(mapped(spread, run, "block long, ids binary, q binary, q_tid binary, w binary, floor binary"), "query-blocks")


def _raised(blocks: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """``blocks`` with the score that each query's ``top``-th best of ``found`` has."""
    own = W.Window.partitionBy("q").orderBy(F.desc("score"))
    floor = found.withColumn("r", F.row_number().over(own)).where(F.col("r") == top).select("q", F.col("score").alias("least"))
    each = blocks.select("block", "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(int(b), int(i), k) for b, ids in zip(pdf["block"], pdf["ids"]) for k, i in enumerate(np.frombuffer(ids, dtype=np.int64))]
            yield pd.DataFrame(out, columns=["block", "q", "k"])

    placed = mapped(each, run, "block long, q long, k long").join(floor, "q", "left").select("block", "k", F.coalesce("least", F.lit(0)).alias("least"))
    floors = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "least"))).alias("x")).select("block", F.transform("x", lambda p: p["least"]).alias("least"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["floor"] = [np.array(x, dtype=np.int64).tobytes() for x in pdf["least"]]
            yield pdf.drop(columns="least")

    return written(mapped(blocks.drop("floor").join(floors, "block"), joined, "block long, ids binary, q binary, q_tid binary, w binary, floor binary"), "query-blocks")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, terms_bytes: int = TERMS_BYTES, piece: int = PIECE) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best rows of ``docs`` (doc_id, text) with a score above 0 for each row of ``items`` (item_id, text).

    Equal scores go to the smaller doc_id, null last. Null, empty and termless texts hold no terms: such documents don't count, such items get no
    rows. Repeated documents are each ranked, repeated items each answered. Terms that every item or document holds count
    like others. Other columns are not read; empty tables give no rows.
    """
    found = F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(f"({PATTERN})"), F.lit(1)))
    asked = written(items.select("item_id", found.alias("terms")).withColumn("q", F.monotonically_increasing_id()), "items")
    words = written(asked.select("q", F.explode("terms").alias("term")), "item-terms")
    terms = written(words.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "query-terms")
    counts = term_counts(docs, terms, terms_bytes)
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    empty = asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    if not n:
        return empty
    df = counts.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1)))
    terms = terms.join(df, "tid").select("tid", "term", weight.alias("w"))
    words = written(words.join(terms, "term").where("w > 0").select("q", "tid", "w"), "weighted-terms")
    queries = words.select("q").distinct().count()
    blocks = _blocks(words, queries)
    index = built_index(counts, n, total, piece)
    blocks = _raised(blocks, visited(_met_blocks(index, blocks), top, True), top)
    best = visited(_met_blocks(index, blocks), top, False)
    own = W.Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` for each item of ``benchmark``, ten each; nulls, ties and repeats as ``ranked`` says."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{PATTERN}')) AS term FROM documents),
p AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM d GROUP BY r, term),
n AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r), g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM n),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, n_docs),
m AS MATERIALIZED (SELECT r, 100 - 90 + (90 * n * n_docs) // total AS m FROM n, g),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{PATTERN}')) AS terms FROM benchmark),
s AS (SELECT q, any_value(item_id) AS item_id, p.r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(terms) AS term FROM q) JOIN w USING (term) JOIN p USING (term) JOIN m ON m.r = p.r GROUP BY q, p.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {"op13_ranked_lexical_search": op13_ranked_lexical_search}
ORACLE = {"op13_ranked_lexical_search": SQL}
