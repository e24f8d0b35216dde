"""Agglomeration of projects all of whose pairs are scored, on tiles of their matrix of links instead of a row a pair.

A project's clusters lie in strips of about SIDE; the links of two strips are a tile, made anew from the vectors of the clusters' members in the task that
looks at it, so no round writes or shuffles links. A round finds each cluster's nearest in tasks over tiles, and pairs that are each other's nearest merge.
A project of up to WHOLE strips' clusters is finished in one task, to which its tiles are sent.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dendrospark.operators.forest import components
from dendrospark.operators.matching import comparable, euclidean
from dendrospark.operators.storage import Rounds, kept
from dendrospark.operators.windows import numbered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Clusters of a strip.
SIDE = 1024

#: Strips whose clusters one task finishes, as a matrix of 134 MB at most.
WHOLE = 4

#: Clusters whose merges can bring them closer that are one task's, at most.
CLOSE = 4096

#: Members whose distances a tile holds at once, before they are joined.
ROWS = 256

_FOUND = "p long, r1 long, r2 long, score double, round int"

#: Merges (place, place, score, round) of a matrix of links and the clusters' sizes.
Run = Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, int, float, int]]]


@dataclass(frozen=True)
class Linkage:
    """How links of clusters are held: what a score starts as, whether of links that become one the largest stands (else their sum), and the score of a link between so many pairs of members."""

    start: Callable[[np.ndarray], np.ndarray]
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    largest: bool = False


@dataclass(frozen=True)
class Tiles:
    """Items (p, rank, head, embedding), nodes (p, rank, strip, slot, size) and ids (project, id, p, rank); p is a project's number, rank an item's place among its ids, head the rank of the node that it is in.

    ``start`` makes links of Euclidean distances, ``largest`` says how those that become one are joined.
    """

    items: DataFrame
    nodes: DataFrame
    ids: DataFrame
    start: Callable[[np.ndarray], np.ndarray]
    largest: bool = False
    side: int = SIDE


@dataclass
class Tile:
    """Links of the nodes of strips a and b of a project, with the nodes' ranks and sizes."""

    p: int
    a: int
    b: int
    cells: np.ndarray
    ranks: tuple[np.ndarray, np.ndarray]
    sizes: tuple[np.ndarray, np.ndarray]

    def scores(self, linkage: Linkage) -> np.ndarray:
        """A cluster's own at infinity."""
        with np.errstate(over="ignore", divide="ignore"):
            s = linkage.score(self.cells, self.sizes[0][:, None] * self.sizes[1][None].astype("float64"))
        if self.a == self.b:
            s = s.copy()
            np.fill_diagonal(s, np.inf)
        return s


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """As ``F.round``: halves of the printed digits go up."""
    y = x * 10.0**places
    y += 0.5
    whole = np.floor(y)
    y -= whole
    for at in zip(*np.nonzero((y < 1e-5) | (y > 1 - 1e-5))):
        whole[at] = int(Decimal(repr(float(x[at]))).scaleb(places).quantize(Decimal(1), ROUND_HALF_UP))
    return whole / 10.0**places


def _placed(nodes: DataFrame, side: int) -> DataFrame:
    """Nodes (p, rank, size) in strips of about ``side``."""
    count = nodes.groupBy("p").agg(F.ceil(F.count("*") / side).cast("int").alias("_n"))
    return kept(_slotted(nodes.join(F.broadcast(count), "p").withColumn("strip", F.pmod(F.xxhash64("rank"), F.col("_n")).cast("int"))), "nodes")


def _slotted(nodes: DataFrame) -> DataFrame:
    slot = F.row_number().over(Window.partitionBy("p", "strip").orderBy("rank")) - 1
    return nodes.select("p", "rank", "strip", slot.alias("slot"), "size")


def from_vectors(items: DataFrame, start: Callable[[np.ndarray], np.ndarray], largest: bool = False, side: int = SIDE) -> Tiles:
    """Tiles of what ``start`` makes of the Euclidean distances of ``comparable`` items (project, id, embedding) with ids of their own."""
    projects = kept(kept(items.select("project").distinct(), "projects").withColumn("p", F.monotonically_increasing_id()), "projects")
    ranked = numbered(items.select("project", "id"), ["project"], [F.col("id")], "rank")
    ids = kept(ranked.join(F.broadcast(projects), "project").select("project", "id", "p", "rank"), "ids")
    rows = items.join(ids, ["project", "id"]).select("p", "rank", F.col("rank").alias("head"), "embedding")
    return Tiles(kept(rows, "items"), _placed(ids.select("p", "rank", F.lit(1).cast("long").alias("size")), side), ids, start, largest, side)


def _folded(links: Callable[[np.ndarray, np.ndarray], np.ndarray], ends: list[tuple[np.ndarray, np.ndarray]], largest: bool) -> np.ndarray:
    """``links`` of all vectors of both ends (vectors, places: rising), those of one place joined; ROWS vectors at a time."""
    join = np.maximum if largest else np.add
    (x, i), (y, j) = ends
    first = np.flatnonzero(np.diff(j, prepend=-1))
    out = np.full((i[-1] + 1, len(first)), -np.inf if largest else 0.0)
    for at in range(0, len(x), ROWS):
        m, own = links(x[at : at + ROWS], y), i[at : at + ROWS]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        if len(begin) < len(own):
            m = join.reduceat(m, begin, axis=0)
        if len(first) < len(j):
            m = join.reduceat(m, first, axis=1)
        out[own[begin]] = join(out[own[begin]], m)
    return out


def over(t: Tiles, run: Callable[..., pd.DataFrame], schema: str, within: bool = False, beside: DataFrame | None = None) -> DataFrame:
    """What ``run`` gives for each tile; ``within``: for those of one strip only. ``beside``: rows of each p that ``run`` takes as well."""
    start, largest, columns = t.start, t.largest, [c.split()[0] for c in schema.split(", ")]
    rows = t.items.join(t.nodes.withColumnRenamed("rank", "head"), ["p", "head"]).select("p", "strip", "slot", "rank", "head", "size", "embedding")
    other = F.col("strip")
    if not within:
        count = t.nodes.groupBy("p").agg((F.max("strip") + 1).alias("_n"))
        rows, other = rows.join(F.broadcast(count), "p").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))), F.col("_t")
    rows = rows.select("p", F.least("strip", other).alias("a"), F.greatest("strip", other).alias("b"), "strip", "slot", "rank", "head", "size", "embedding")

    def each(pdf: pd.DataFrame, *more: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in columns})
        p, a, b = (int(pdf[c].iloc[0]) for c in ("p", "a", "b"))
        ends, ranks, sizes = [], [], []
        for strip in (a,) if a == b else (a, b):
            own = pdf[pdf["strip"] == strip].sort_values(["slot", "rank"])
            if not len(own):  # a strip without nodes
                return pd.DataFrame({c: [] for c in columns})
            place = np.cumsum(np.diff(own["slot"].to_numpy(), prepend=-1) > 0) - 1
            first = np.flatnonzero(np.diff(place, prepend=-1))
            ends.append((np.stack(own["embedding"].to_numpy()).astype("float64"), place))
            ranks.append(own["head"].to_numpy()[first])
            sizes.append(own["size"].to_numpy()[first])
        cells = _folded(lambda x, y: start(euclidean(x, y)), [ends[0], ends[-1]], largest)
        if a == b:  # sums the other way round can differ in the last digit
            cells = np.triu(cells) + np.triu(cells, 1).T
        return run(Tile(p, a, b, cells, (ranks[0], ranks[-1]), (sizes[0], sizes[-1])), *more)

    n = t.items.groupBy("p").agg(F.count("*").cast("double").alias("n"))
    tasks = int(min(4096, 1 + (n.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) // (1 << 22)))
    rows = rows.repartition(tasks, "p", "a", "b").groupBy("p", "a", "b")
    if beside is None:
        return rows.applyInPandas(each, schema)
    ends = t.nodes.groupBy("p").agg(F.sequence(F.lit(0), F.max("strip")).alias("_n")).withColumn("a", F.explode("_n")).withColumn("b", F.explode("_n")).where("a = b" if within else "a <= b")
    beside = beside.join(ends.drop("_n"), "p").repartition(tasks, "p", "a", "b").groupBy("p", "a", "b")
    return rows.cogroup(beside).applyInPandas(lambda x, y: each(x, y), schema)


def nearest(t: Tiles, linkage: Linkage) -> DataFrame:
    """(p, rank, score, partner): each node's nearest, of equal ones the smaller (r1, r2)."""

    def run(tile: Tile) -> pd.DataFrame:
        s, out = tile.scores(linkage), []
        for way in range(1 if tile.a == tile.b else 2):
            at = s.argmin(axis=1 - way)
            low = s[np.arange(len(at)), at] if way == 0 else s[at, np.arange(len(at))]
            some = low < np.inf
            out.append(pd.DataFrame({"p": tile.p, "rank": tile.ranks[way][some], "score": low[some], "partner": tile.ranks[1 - way][at[some]]}))
        return pd.concat(out)

    found = over(t, run, "p long, rank long, score double, partner long")
    return found.groupBy("p", "rank").agg(F.min(F.struct("score", "partner")).alias("e")).select("p", "rank", "e.score", "e.partner")


def mutual(near: DataFrame) -> DataFrame:
    """(p, r1, r2, score): pairs that are each other's nearest."""
    pairs = near.groupBy("p", F.least("rank", "partner").alias("r1"), F.greatest("rank", "partner").alias("r2"))
    return pairs.agg(F.min("score").alias("score"), F.count("*").alias("_n")).where("_n = 2").drop("_n")


def merged(t: Tiles, pairs: DataFrame) -> Tiles:
    """Tiles after r2 of each pair (p, r1, r2) has become r1."""
    moved = pairs.select("p", F.col("r2").alias("head"), "r1")
    items = kept(t.items.join(moved, ["p", "head"], "left").select("p", "rank", F.coalesce("r1", "head").alias("head"), "embedding"), "items")
    return replace(t, items=items, nodes=_placed(items.groupBy("p", F.col("head").alias("rank")).agg(F.count("*").alias("size")), t.side))


def _merges(p: int, ranks: np.ndarray, found: Iterator[tuple[int, int, float, int]], at: int = 0) -> pd.DataFrame:
    got = pd.DataFrame(list(found), columns=["r1", "r2", "score", "round"])
    return pd.DataFrame({"p": p, "r1": ranks[got["r1"].astype("int64")], "r2": ranks[got["r2"].astype("int64")], "score": got["score"].astype("float64"), "round": (got["round"] + at).astype("int32")})


def _finished(t: Tiles, run: Callable[[int], Run], at: int = 0) -> DataFrame:
    """What ``run`` of each project gives for the links and sizes of all its nodes, as (p, r1, r2, score, round); all tiles of a project are one task's."""

    def piece(tile: Tile) -> pd.DataFrame:
        row = {"p": tile.p, "cells": tile.cells.tobytes()}
        for k, end in enumerate("ab"):
            row |= {f"rank_{end}": tile.ranks[k].astype("int64").tobytes(), f"size_{end}": tile.sizes[k].astype("int64").tobytes()}
        return pd.DataFrame([row])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        size = {}
        for r in pdf.itertuples():
            for i, n in ((r.rank_a, r.size_a), (r.rank_b, r.size_b)):
                size |= zip(np.frombuffer(i, dtype="int64").tolist(), np.frombuffer(n, dtype="int64").tolist())
        ranks = np.array(sorted(size), dtype="int64")
        cells = np.zeros((len(ranks), len(ranks)))
        for r in pdf.itertuples():
            i, j = (np.searchsorted(ranks, np.frombuffer(x, dtype="int64")) for x in (r.rank_a, r.rank_b))
            own = np.frombuffer(r.cells).reshape(len(i), len(j))
            cells[np.ix_(i, j)] = own
            cells[np.ix_(j, i)] = own.T
        p = int(pdf["p"].iloc[0])
        return _merges(p, ranks, run(p)(cells, np.array([size[x] for x in ranks.tolist()], dtype="float64")), at)

    pieces = over(t, piece, "p long, cells binary, rank_a binary, size_a binary, rank_b binary, size_b binary")
    projects = t.nodes.select("p").distinct().count()
    return pieces.repartition(min(4096, 4 * projects + 1), "p").groupBy("p").applyInPandas(whole, _FOUND)


def _split(t: Tiles) -> tuple[Tiles | None, Tiles | None]:
    """Projects of up to WHOLE strips' nodes, and the others, if there are any."""
    few = kept(t.nodes.groupBy("p").agg((F.count("*") <= WHOLE * t.side).alias("few")), "few")
    kinds = {r[0] for r in few.select("few").distinct().collect()}
    out = []
    for kind in (True, False):
        own = F.broadcast(few.where(F.col("few") == kind).select("p"))
        out.append(None if kind not in kinds else t if len(kinds) == 1 else replace(t, items=t.items.join(own, "p", "left_semi"), nodes=t.nodes.join(own, "p", "left_semi")))
    return out[0], out[1]


def one_by_one(linkage: Linkage, most: float, below: float = np.inf) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, int, float, int]]]:
    """One merge at a time of the least (score, place, place) not above ``most`` and less than ``below``; of a merge only the rows whose nearest it was are searched again."""

    def run(t: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        with np.errstate(over="ignore", divide="ignore"):
            n = len(t)
            score = linkage.score(t, size[:, None] * size[None]).copy()
            score[np.tril_indices(n)] = np.inf  # a pair stands in the row of its smaller place
            near = score.argmin(axis=1)
            best, live = score[np.arange(n), near], np.ones(n, dtype=bool)
            for step in range(n - 1):
                a = int(best.argmin())
                b, x = int(near[a]), float(best[a])
                if not x < below or x > most:
                    return
                yield a, b, x, step
                t[a] = np.maximum(t[a], t[b]) if linkage.largest else t[a] + t[b]
                t[:, a] = t[a]
                size[a] += size[b]
                live[b] = False
                own = np.where(live, linkage.score(t[a], size[a] * size), np.inf)
                score[b], score[:, b], best[b] = np.inf, np.inf, np.inf
                score[a, a + 1 :], score[:a, a] = own[a + 1 :], own[:a]
                again = np.flatnonzero(((near == a) | (near == b)) & live)
                again = np.union1d(again, [a])
                near[again] = score[again].argmin(axis=1)
                best[again] = score[again, near[again]]
                low = score[:, a]
                nearer = (low < best) | ((low == best) & (a < near) & (low < np.inf))
                near[nearer], best[nearer] = a, low[nearer]

    return run


def _greedy(s: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """What taking pairs of finite score in order, each place once, gives; only places whose nearest was taken are searched again."""
    rows, live = np.arange(len(s)), np.ones(len(s), dtype=bool)
    near = s.argmin(axis=1) if len(s) else rows
    low = s[rows, near]
    live &= low < np.inf
    while live.any():
        a = np.flatnonzero(live & (near[near] == rows) & (rows < near))
        if not len(a):
            return
        yield from zip(a.tolist(), near[a].tolist(), low[a].tolist())
        live[a], live[near[a]] = False, False
        left = np.flatnonzero(live)
        again = left[~live[near[left]]]
        for at in range(0, len(again), 256):
            own = again[at : at + 256]
            part = s[np.ix_(own, left)]
            k = part.argmin(axis=1)
            near[own], low[own] = left[k], part[np.arange(len(own)), k]
        live[again] = low[again] < np.inf


def bundles(linkage: Linkage, tops: Callable[[float], list[float]], most: float = np.inf, bundle: int | None = None) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, int, float, int]]]:
    """Rounds of greedy matchings, each of the scores up to the first of ``tops`` of the least score at which one is left; at most ``bundle`` merges a round."""

    def run(t: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        live, step = np.arange(len(t)), 0
        with np.errstate(over="ignore", divide="ignore"):
            while len(live) > 1:
                s = linkage.score(t, size[:, None] * size[None]).copy()
                np.fill_diagonal(s, np.inf)
                least = s.min()
                top = next((x for x in tops(float(least)) if least <= x), None)
                if top is None or least > most:
                    return
                s[s > min(top, most)] = np.inf
                pairs = sorted(_greedy(s), key=lambda x: (x[2], x[0], x[1]))[:bundle]
                gone = np.zeros(len(live), dtype=bool)
                for a, b, x in pairs:
                    yield int(live[a]), int(live[b]), x, step
                    t[a] = np.maximum(t[a], t[b]) if linkage.largest else t[a] + t[b]
                    t[:, a] = t[a]
                    size[a] += size[b]
                    gone[b] = True
                live, size, t, step = live[~gone], size[~gone], t[np.ix_(~gone, ~gone)], step + 1

    return run


def reduced(t: Tiles, linkage: Linkage, threshold: float | None = None) -> DataFrame:
    """The merges (p, r1, r2, score, round) for a linkage that no merge brings closer: mutual nearest clusters merge in a round."""
    done, at, rest = Rounds(t.nodes.sparkSession, "merges"), 0, t
    most = np.inf if threshold is None else threshold
    while rest is not None:
        few, rest = _split(rest)
        if few is not None:
            done.add(_finished(few, lambda p: one_by_one(linkage, most), at))
        if rest is None:
            break
        found = mutual(nearest(rest, linkage)).where(F.col("score") <= most)
        found = done.add(found.withColumn("round", F.lit(at)))
        if found.isEmpty():
            break
        rest, at = merged(rest, found), at + 1
    return done.all()


def closest_first(t: Tiles, linkage: Linkage, threshold: float | None = None) -> DataFrame | None:
    """As ``reduced`` with ``key`` (score, r1, r2), in whose order the merges come, for a geometric mean with a pseudo count.

    While scores are below one, a merge can bring clusters closer still, but only those that are joined by such scores: what they make of clusters not so joined is one or more. So
    each component of such links is merged one at a time, apart from the others; after that no merge brings clusters closer. None where a component has more than CLOSE items.
    """

    def close(tile: Tile) -> pd.DataFrame:
        i, j = np.nonzero(tile.scores(linkage) < 1)
        return pd.DataFrame({"p": tile.p, "a": tile.ranks[0][i], "b": tile.ranks[1][j]})

    most = np.inf if threshold is None else threshold
    links = kept(over(t, close, "p long, a long, b long").where("a <> b").distinct(), "close")
    key = F.struct("score", "r1", "r2").alias("key")
    if links.isEmpty():
        return reduced(t, linkage, threshold).withColumn("key", key)
    ends = kept(components(links, "p").select("p", F.col("node").alias("rank"), "end"), "ends")
    sizes = ends.groupBy("p", "end").count()
    if sizes.agg(F.max("count")).first()[0] >= CLOSE:
        return None
    heads = ends.select("p", F.col("end").alias("rank"), "end").distinct().unionByName(ends)
    part = F.dense_rank().over(Window.partitionBy("p").orderBy("end")) - 1
    own = kept(_slotted(heads.select("p", "rank", part.alias("strip"), F.lit(1).cast("long").alias("size"))), "close-nodes")
    alone = one_by_one(linkage, most, 1.0)
    first = kept(over(replace(t, nodes=own), lambda tile: _merges(tile.p, tile.ranks[0], alone(tile.cells, tile.sizes[0].astype("float64"))), _FOUND, within=True), "close-merges")
    part = own.select("p", F.col("rank").alias("r1"), "strip")
    ranked = first.join(part, ["p", "r1"]).withColumn("key", F.max(F.struct("score", "r1", "r2")).over(Window.partitionBy("p", "strip").orderBy("round"))).drop("strip")
    heads = components(first.select("p", F.col("r1").alias("a"), F.col("r2").alias("b")), "p")
    rest = merged(t, heads.select("p", F.col("end").alias("r1"), F.col("node").alias("r2")))
    later = reduced(rest, linkage, threshold).withColumns({"key": key, "round": F.col("round") + F.lit(1 << 24)})
    return ranked.select(*later.columns).unionByName(later)


def _matched(t: Tiles, linkage: Linkage, top: Callable[[Column], Column], most: float) -> DataFrame:
    """(p, r1, r2, score): the greedy matching of each project's scores up to ``top`` of its least one; projects of up to WHOLE strips' nodes that are left are one task's each."""
    taken, rest, tops = Rounds(t.nodes.sparkSession, "matched"), t, None
    while True:
        near = kept(nearest(rest, linkage), "near")
        if tops is None:
            tops = kept(near.groupBy("p").agg(F.least(top(F.min("score")), F.lit(most)).alias("_top")), "tops")
        found = taken.add(mutual(near.join(F.broadcast(tops), "p").where("score <= _top")))
        if found.isEmpty():
            return taken.all()
        used = found.select("p", F.explode(F.array("r1", "r2")).alias("rank"))
        # what has nothing up to the top now won't have later
        some = near.join(F.broadcast(tops), "p").where("score <= _top").select("p", "rank").join(used, ["p", "rank"], "left_anti")
        few, rest = _split(replace(rest, nodes=_placed(rest.nodes.join(some, ["p", "rank"], "left_semi").select("p", "rank", "size"), t.side)))
        if few is not None:
            limits = {r["p"]: r["_top"] for r in tops.join(few.nodes.select("p").distinct(), "p").collect()}
            taken.add(_finished(few, lambda p, limits=limits: _limited(linkage, limits.get(p, -np.inf))).drop("round"))
        if rest is None:
            return taken.all()


def _limited(linkage: Linkage, most: float) -> Run:
    def run(t: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        with np.errstate(over="ignore", divide="ignore"):
            s = linkage.score(t, size[:, None] * size[None]).copy()
        np.fill_diagonal(s, np.inf)
        s[s > most] = np.inf
        for a, b, x in _greedy(s):
            yield a, b, x, 0

    return run


def windowed(t: Tiles, linkage: Linkage, top: Callable[[Column], Column], local: Callable[[float], float], threshold: float | None = None) -> DataFrame:
    """The merges (p, r1, r2, score, round) of bundles: all of a greedy matching of scores up to ``top`` of each project's least (``local``: the same of a number) merge in a round."""
    done, at, rest = Rounds(t.nodes.sparkSession, "merges"), 0, t
    most = np.inf if threshold is None else threshold
    while rest is not None:
        few, rest = _split(rest)
        if few is not None:
            done.add(_finished(few, lambda p: bundles(linkage, lambda x: [local(x)], most), at))
        if rest is None:
            break
        found = done.add(_matched(rest, linkage, top, most).withColumn("round", F.lit(at)))
        if found.isEmpty():
            break
        rest, at = merged(rest, found), at + 1
    return done.all()


def laddered(t: Tiles, linkage: Linkage, thresholds: tuple[float, ...], bundle: int | None = None) -> DataFrame:
    """The merges (p, r1, r2, score, round) at rising thresholds: at each, greedy matchings of the scores up to it merge until one is empty."""
    done, at, rest = Rounds(t.nodes.sparkSession, "merges"), 0, t
    for k, threshold in enumerate(thresholds):
        while rest is not None:
            few, rest = _split(rest)
            if few is not None:
                done.add(_finished(few, lambda p, own=thresholds[k:]: bundles(linkage, lambda x: list(own), bundle=bundle), at))
            if rest is None:
                break
            found = _matched(rest, linkage, lambda c, x=threshold: F.lit(x), threshold)
            if bundle is not None:
                found = numbered(found, ["p"], [F.col(c) for c in ("score", "r1", "r2")], "_n").where(F.col("_n") <= bundle).drop("_n")
            found = done.add(found.withColumn("round", F.lit(at)))
            if found.isEmpty():
                break
            rest, at = merged(rest, found), at + 1
    return done.all()


def _grown(s: np.ndarray, ranks: tuple[np.ndarray, np.ndarray], one: bool) -> Iterator[tuple[int, int, float]]:
    """The minimum spanning tree (rank, rank, score) of a tile's scores, in the order of (score, r1, r2); ``one``: both strips are the same."""
    n = s.shape[0]
    every = ranks[0] if one else np.concatenate(ranks)
    best, by, out = np.full(len(every), np.inf), np.full(len(every), -1), np.ones(len(every), dtype=bool)
    across, last = np.ascontiguousarray(s.T), 0
    for _ in range(len(every) - 1):
        out[last], best[last] = False, np.inf
        own = slice(None) if one else slice(n, None) if last < n else slice(0, n)
        row = s[last] if last < n else across[last - n]
        low, held = best[own], by[own]
        nearer = out[own] & ((row < low) | ((row == low) & (every[last] < held)))
        low[nearer], held[nearer] = row[nearer], every[last]
        at = np.flatnonzero((best == best.min()) & out)
        if len(at) > 1:
            at = at[np.lexsort((np.maximum(every[at], by[at]), np.minimum(every[at], by[at])))]
        last = int(at[0])
        if best[last] == np.inf:
            return
        yield min(int(every[last]), int(by[last])), max(int(every[last]), int(by[last])), float(best[last])


def spanning(t: Tiles) -> DataFrame:
    """(project, id1, id2, score): links among which a minimum spanning forest of all is, one tree a tile."""

    def run(tile: Tile) -> pd.DataFrame:
        s = tile.cells.copy()
        if tile.a == tile.b:
            np.fill_diagonal(s, np.inf)
        return pd.DataFrame(list(_grown(s, tile.ranks, tile.a == tile.b)), columns=["r1", "r2", "score"]).assign(p=tile.p)[["p", "r1", "r2", "score"]]

    found = kept(over(t, run, "p long, r1 long, r2 long, score double").withColumn("round", F.lit(0)), "spanning")
    return named(t, found).drop("round")


def ranks(t: Tiles, scores: DataFrame) -> DataFrame:
    """(project, score, rank): one more than the links of a project that are below each of ``scores`` (project, score)."""
    names = t.ids.select("p", "project").distinct()
    limits = scores.join(F.broadcast(names), "project").groupBy("p").agg(F.array_sort(F.collect_set("score")).alias("limits"))

    def count(tile: Tile, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"p": [], "limits": [], "below": []})
        limits = np.asarray(own["limits"].iloc[0], dtype="float64")
        links = tile.cells[np.triu_indices(len(tile.cells), 1)] if tile.a == tile.b else tile.cells.ravel()
        links = np.sort(links)
        return pd.DataFrame({"p": [tile.p], "limits": [limits.tobytes()], "below": [np.searchsorted(links, limits).astype("int64").tobytes()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        below = sum(np.frombuffer(x, dtype="int64") for x in pdf["below"])
        return pd.DataFrame({"p": pdf["p"].iloc[0], "score": np.frombuffer(pdf["limits"].iloc[0]), "rank": below + 1.0})

    counted = over(t, count, "p long, limits binary, below binary", beside=kept(limits, "limits"))
    return counted.groupBy("p").applyInPandas(total, "p long, score double, rank double").join(F.broadcast(names), "p").drop("p")


def named(t: Tiles, merges: DataFrame, *more: str) -> DataFrame:
    """``merges`` as (project, id1, id2, score, round, more)."""
    ids = t.ids.select("p", "rank", "project", "id")
    for end in ("1", "2"):
        own = ids.withColumnsRenamed({"rank": f"r{end}", "id": f"id{end}"})
        merges = merges.join(own if end == "1" else own.drop("project"), ["p", f"r{end}"])
    return merges.select("project", "id1", "id2", "score", "round", *more)


def distinct_vectors(items: DataFrame) -> bool:
    """Whether items (project, id, embedding) are ``comparable`` and have ids of their own."""
    return comparable(items) and items.groupBy("project", "id").count().where("count > 1").isEmpty()
