"""Single linkage by a minimum spanning forest.

Boruvka's rounds: every cluster takes its least link, whether or not it is that of the other side too, so clusters at least halve in
a round. Of equal scores the smaller (id1, id2) is the lesser link. Before the first round each task leaves the forest of every PART of its own links: what isn't in the
forest of some links isn't in that of all. The forest's links, sorted, are the merges; which clusters each joins is found
by halving the sorted links: the clusters that a lower half makes are names in the upper half, until a block of links is small enough for one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from dendrospark.operators.jumps import chain_ends
from dendrospark.operators.storage import Rounds, kept
from dendrospark.operators.windows import numbered

#: Links that one task joins one after the other.
BLOCK = 10_000

#: Links that a task thins at once.
PART = 1 << 19


def _relabelled(links: DataFrame, names: DataFrame, *group: str) -> DataFrame:
    """``links`` with a and b replaced through names (group, node, end)."""
    for side in ("a", "b"):
        own = names.select(*group, F.col("node").alias(side), F.col("end").alias("_end"))
        links = links.join(own, [*group, side], "left").withColumn(side, F.coalesce("_end", side)).drop("_end")
    return links


def thinned(links: DataFrame, part: int = PART) -> DataFrame:
    """Links (project, id1, id2, score) without those that aren't in the forest of some ``part`` links of their task: where a task has all links of a tile, few are left."""

    def forest_rows(pdf: pd.DataFrame) -> np.ndarray:
        """Which rows (project, id1, id2, score) are links of their own minimum spanning forest, by Boruvka's rounds."""
        ids, names = pd.factorize(pd.concat([pdf["id1"], pdf["id2"]], ignore_index=True), sort=True)
        one, two = ids[: len(pdf)], ids[len(pdf) :]
        order = np.lexsort((two, one, pdf["score"].to_numpy()))
        project = pd.factorize(pdf["project"])[0].astype("int64") * len(names)
        ends, nodes = pd.factorize(np.concatenate([(project + one)[order], (project + two)[order]]))
        a, b, n, m = ends[: len(pdf)], ends[len(pdf) :], len(nodes), len(pdf)
        root, left, taken = np.arange(n), np.arange(m), []
        while True:
            x, y = root[a[left]], root[b[left]]
            apart = x != y
            left, x, y = left[apart], x[apart], y[apart]
            if not len(left):
                return order[np.concatenate(taken)] if taken else order[:0]
            best = np.full((2, n), m)
            for side, end in enumerate((x, y)):
                best[side, end[::-1]] = left[::-1]  # of repeats the last stands: the least
            best = best.min(axis=0)
            some = np.flatnonzero(best < m)
            taken.append(np.unique(best[some]))
            to, link = np.arange(n), best[some]
            to[some] = np.where(root[a[link]] == some, root[b[link]], root[a[link]])
            same = (to[to] == np.arange(n)) & (np.arange(n) < to)  # of two that take the same link, the smaller stays
            to[same] = np.flatnonzero(same)
            while (to[to] != to).any():
                to = to[to]
            root = to[root]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= part:
                rows = pd.concat(held, ignore_index=True)
                held = []
                yield rows.iloc[forest_rows(rows)]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield rows.iloc[forest_rows(rows)]

    return links.select("project", "id1", "id2", "score").mapInPandas(thin, links.select("project", "id1", "id2", "score").schema)


def spanning_forest(scores: DataFrame) -> tuple[DataFrame, int]:
    """The links (project, id1, id2, score) of each project's minimum spanning forest, and how many rounds it took. Links without a score don't count."""
    known = scores.where("score IS NOT NULL")
    if isinstance(scores.schema["project"].dataType, AtomicType):
        known = thinned(known.where("project IS NOT NULL AND id1 IS NOT NULL AND id2 IS NOT NULL"))
    links = kept(known.select("project", F.struct("score", "id1", "id2").alias("edge"), F.col("id1").alias("a"), F.col("id2").alias("b")), "links")
    taken = Rounds(scores.sparkSession, "forest")
    while True:
        both = links.select("project", F.col("a").alias("node"), F.struct("edge", F.col("b").alias("to")).alias("e"))
        both = both.unionByName(links.select("project", F.col("b").alias("node"), F.struct("edge", F.col("a").alias("to")).alias("e")))
        best = kept(both.groupBy("project", "node").agg(F.min("e").alias("e")).select("project", "node", "e.edge", "e.to"), "least-links")
        found = taken.add(best.select("project", "edge.id1", "edge.id2", "edge.score").distinct())
        if found.isEmpty():
            return taken.all(), taken.n - 1
        back = best.select("project", F.col("node").alias("to"), F.col("to").alias("_back"))
        root = (F.col("_back") == F.col("node")) & (F.col("node") < F.col("to"))  # of two that take the same link, the smaller stays
        ends = chain_ends(best.join(back, ["project", "to"]).where(~root).select("project", "node", "to"), "project")
        moved = _relabelled(links, ends, "project").where("a <> b")
        links = kept(moved.groupBy("project", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("edge").alias("edge")), "links")


def components(links: DataFrame, *group: str) -> DataFrame:
    """(group, node, end): the smallest node that each of links (group, a, b) reaches; it itself is left out.

    Every node moves to its smallest neighbour, if that is smaller; where the moves end, nodes become one, until no link is left.
    """
    now, out = kept(links.select(*group, "a", "b"), "component-links"), Rounds(links.sparkSession, "component-moves")
    moved: DataFrame | None = None
    while not now.isEmpty():
        both = now.select(*group, F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to"))
        ends = out.add(chain_ends(both.groupBy(*group, "node").agg(F.min("to").alias("to")), *group))
        moved = out.all()
        now = kept(_relabelled(now, ends, *group).where("a <> b").select(*group, "a", "b").distinct(), "component-links")
    if moved is None:
        return now.select(*group, F.col("a").alias("node"), F.col("b").alias("end"))
    return chain_ends(moved.select(*group, "node", F.col("end").alias("to")), *group)


def forest_merges(forest: DataFrame, block: int = BLOCK) -> DataFrame:
    """(project, step, id1, id2, score): the forest's links in order, with the smallest leaf of both clusters that each joins (id1 < id2)."""
    ranked = numbered(forest, ["project"], [F.col("score"), F.col("id1"), F.col("id2")], "step")
    links = kept(ranked.select("project", "step", "score", F.col("id1").alias("a"), F.col("id2").alias("b")), "ranked-links")
    most = links.agg(F.max("step")).first()[0] or 0
    size = block
    while size < most:
        size *= 2
    while size > block:
        half = F.floor((F.col("step") - 1) / (size // 2))
        at = links.withColumns({"_block": F.floor((F.col("step") - 1) / size), "_upper": half % 2 == 1})
        names = components(at.where("NOT _upper"), "project", "_block")
        upper = _relabelled(at.where("_upper"), names, "project", "_block")
        links = kept(at.where("NOT _upper").unionByName(upper).select("project", "step", "score", "a", "b"), "ranked-links")
        size //= 2

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block: links one after the other, each with the smallest names of what it joins."""
        pdf, root, low, high = pdf.sort_values("step"), {}, [], []
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            for x in (a, b):
                root.setdefault(x, x)
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            while root[b] != b:
                root[b] = root[root[b]]
                b = root[b]
            a, b = min(a, b), max(a, b)
            root[b] = a
            low.append(a)
            high.append(b)
        return pdf.assign(a=low, b=high)[["project", "step", "score", "a", "b"]]

    schema = links.schema
    done = links.groupBy("project", F.floor((F.col("step") - 1) / block).alias("_block")).applyInPandas(joined, schema)
    return done.select("project", "step", F.col("a").alias("id1"), F.col("b").alias("id2"), "score")

