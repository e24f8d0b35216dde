"""SimHash near-duplicates by pigeonhole blocks (operator 3).

A fingerprint is cut into ``blocks`` blocks. Two that differ in at most ``distance``
bits agree in at least ``blocks - distance`` blocks, so each choice of that many
blocks is a key and a close pair shares at least one key. Rows meet by key, equal
fingerprints as one row; within a key the Hamming distance is verified and only
the edges of a spanning forest leave, so a dense group of n near copies gives n - 1
edges, not their square. Components are found by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.llm.common import mapped, small, table, whole_groups, written

WORDS, DISTANCE, BLOCKS = 4, 4, 6
#: A key with more fingerprints than this is cut by further blocks of the other bits before its rows are dealt to tasks.
KEY_ROWS = 20_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text, bit 63 first in its hex form."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    k = min(words, len(w))
    starts = np.append(0, ends[:-1] + 1)[: len(w) - k + 1].tolist()
    h = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())]
    set_ = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):  # bits of a few thousand shingles at a time, however long the text
        part = np.array(h[at : at + 4096], dtype=">u8")
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, of each row; zero for null, empty and wordless texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, words) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    return mapped(docs.select("doc_id", "text"), run, docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def _cuts(bits: list[int], blocks: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), blocks)]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints within ``distance``.

    Breadth first: each member is compared with those not yet reached, all at once.
    """
    left, edges = np.array(fps, dtype=np.uint64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                edges += [(int(at), int(x)) for x in left[near]]
                queue += list(left[near])
                left = left[~near]
    return edges


def _long(bits: list[int]) -> int:
    """The mask of bits (0 is the highest) as a signed long."""
    m = sum(1 << (63 - b) for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _masks(fixed: list[int], distance: int, blocks: int) -> list[list[int]]:
    """What keys of fingerprints that agree in the bits ``fixed`` hold fixed at the next level: those bits and some blocks of the others."""
    free = [b for b in range(64) if b not in set(fixed)]
    return [sorted([*fixed, *sum(chosen, [])]) for chosen in combinations(_cuts(free, blocks), blocks - distance)]


def _keyed(rows: DataFrame, masks: Column) -> DataFrame:
    """``rows`` (fp) once for each of the masks: the mask m and the bits k that it keeps."""
    return rows.select("fp", F.explode(masks).alias("m")).withColumn("k", F.col("fp").bitwiseAND(F.col("m")))


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join all that are within ``distance``, directly or in steps.

    ``fps`` holds each fingerprint once. Keys of more than ``key_rows`` fingerprints are counted first and cut by
    further blocks, until none is larger or fewer than 12 bits are free, so no task gets a larger group.
    """
    spark, rows, parts = fps.sparkSession, fps.select("fp"), []
    masks = F.array(*[F.lit(_long(m)) for m in _masks([], distance, blocks)])
    while True:
        keyed = _keyed(rows, masks)
        hot = keyed.where(64 - F.bit_count("m") >= 12).groupBy("m", "k").agg(F.count("*").alias("n"))  # others hold at most 2,048
        hot = written(hot.where(F.col("n") > key_rows).select("m", "k"), "hot-keys")
        met = [r["m"] for r in hot.select("m").distinct().collect()]  # masks are few, however many the keys
        if not met:
            parts.append(keyed)
            break
        parts.append(keyed.join(small(hot), ["m", "k"], "left_anti"))
        further = [(m, [_long(x) for x in _masks([b for b in range(64) if m >> (63 - b) & 1], distance, blocks)]) for m in met]
        cut = keyed.join(small(hot), ["m", "k"], "left_semi").join(small(spark.createDataFrame(further, "m long, masks array<long>")), "m")
        rows, masks = written(cut.select("fp", "masks"), "hot-rows"), F.col("masks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "m", "k"):
            m, k, u = pdf["m"].to_numpy(), pdf["k"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            cut = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
            lows, highs = np.append(0, cut), np.append(cut, len(u))
            two = highs - lows == 2
            a, b = u[lows[two]], u[lows[two] + 1]
            near = np.bitwise_count(a ^ b) <= distance
            edges = list(zip(a[near].tolist(), b[near].tolist()))
            for low, high in zip(lows[highs - lows > 2].tolist(), highs[highs - lows > 2].tolist()):
                edges += forest(u[low:high], distance)
            e = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})

    spread = reduce(DataFrame.unionByName, parts).repartition("m", "k").sortWithinPartitions("m", "k")
    return mapped(spread, run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each can reach. Alternating large-star and small-star rounds, until nothing changes."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, words: int = WORDS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable through links.

    Null, empty and wordless texts have fingerprint zero and link like any other. Null ids are
    ignored as component ids unless a component has no other. Repeated rows give repeated
    results. Other columns are not read.
    """
    docs = written(fingerprints(docs, words), "fingerprints")
    own = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    own = written(own, "distinct-fingerprints")
    roots = components(links(own.select("fp"), distance, blocks))
    linked = own.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "component_id")
    named = own.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = written(named, "named-fingerprints")
    return docs.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, four-word shingles, four bits; nulls, empty texts and repeats as ``near_duplicates`` says."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash_near_duplicates": op3_simhash_near_duplicates}
ORACLE: dict[str, str] = {}
