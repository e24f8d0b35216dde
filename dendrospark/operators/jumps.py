"""Trees by pointer doubling: what lies above or below each node, in as many rounds as the depth has bits.

A tree is merges (project, step, child_a, child_b, parent, score). ``Tree`` names its nodes by numbers and keeps, for
each k, who stands 2**k edges above whom. A fold over all nodes below, a sum over the way to the root, and the pairs themselves follow from these
tables, each descendant counted in one round only: n rows a round, whatever the tree's shape; a chain of n merges takes log2(n) rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrospark.operators.storage import shuffled as kept


def doubled(pointers: DataFrame, most: int) -> list[DataFrame]:
    """From (id, up) the tables (id, up) of 1, 2, 4 ... steps, up to the last with rows. Ways of over ``most`` steps, as in a cycle, are an error."""
    out, now = [], kept(pointers, "jumps")
    while not now.isEmpty():
        if 1 << len(out) > most:
            raise ValueError("the merges have a cycle")
        out.append(now)
        now = kept(now.join(now.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up")), "jumps")
    return out


class Tree:
    """The trees of all projects. A node that is a child of two merges, or a parent of two, is an error, and so is a cycle."""

    def __init__(self, merges: DataFrame):
        at = {"child_a": (0, "child_b"), "child_b": (1, "child_a")}
        none = lambda kind: F.lit(None).cast(kind)
        kind = merges.schema["child_a"].dataType
        rows = merges.select("project", F.col("parent").alias("node"), none(kind).alias("parent"), none("int").alias("side"), none(kind).alias("sibling"), F.lit(1).alias("down"))
        for child, (side, other) in at.items():
            rows = rows.union(merges.select("project", F.col(child), "parent", F.lit(side), F.col(other), F.lit(0)))
        own = rows.groupBy("project", "node").agg(F.max("parent").alias("parent"), F.max("side").alias("side"), F.max("sibling").alias("sibling"), F.count("parent").alias("_up"), F.sum("down").alias("_down"))
        #: id, project, node, parent, side (0, 1; null for a root), sibling, leaf
        self.nodes = kept(own.withColumns({"id": F.monotonically_increasing_id(), "leaf": F.col("_down") == 0}), "nodes")
        n, twice = self.nodes.agg(F.count("*"), F.max(F.greatest("_up", "_down"))).first()
        if n and twice > 1:
            raise ValueError("a node is in two merges as a child, or as a parent")
        self.nodes, self.n = self.nodes.drop("_up", "_down"), n
        self.ids = self.nodes.select("project", "node", "id")

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows of (id, ...) with project and node."""
        return self.nodes.select("id", "project", "node").join(rows, "id").select("project", "node", *columns)

    @cached_property
    def jumps(self) -> list[DataFrame]:
        up = self.ids.select("project", F.col("node").alias("parent"), F.col("id").alias("up"))
        return doubled(self.nodes.where("parent IS NOT NULL").select("id", "project", "parent").join(up, ["project", "parent"]).select("id", "up"), max(1, self.n))

    def fold(self, values: DataFrame, how: Mapping[str, Callable[[str], Column]]) -> DataFrame:
        """(id, ...): for each node, its own values and those of all nodes below, put together by ``how`` (name: F.sum, F.min, F.max)."""
        now = values.select("id", *how)
        for jump in self.jumps:
            moved = jump.join(now, "id").select(F.col("up").alias("id"), *how)
            now = kept(now.unionByName(moved).groupBy("id").agg(*[f(c).alias(c) for c, f in how.items()]), "folded")
        return now

    def climb(self, values: DataFrame, *names: str) -> DataFrame:
        """(id, ..., top): for each node, the sums of ``names`` over itself and all nodes above, and its root's id."""
        now = values.select("id", *names, F.col("id").alias("top"))
        for jump in self.jumps:
            above = now.select(F.col("id").alias("up"), *[F.col(c).alias(f"_{c}") for c in names], F.col("top").alias("_top"))
            both = now.join(jump, "id", "left").join(above, "up", "left")
            now = kept(both.select("id", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names], F.coalesce("_top", "top").alias("top")), "climbed")
        return now

    def ancestors(self) -> DataFrame:
        """(id, above, distance) of all nodes and all above them, each pair made once."""
        parts: list[DataFrame] = []
        for k, jump in enumerate(self.jumps):
            new = jump.select("id", F.col("up").alias("above"), F.lit(1 << k).alias("distance"))
            if parts:
                known = reduce(DataFrame.unionByName, parts).select(F.col("id").alias("up"), "above", F.col("distance"))
                new = new.unionByName(jump.join(known, "up").select("id", "above", (F.col("distance") + (1 << k)).alias("distance")))
            parts.append(kept(new, "ancestors") if k else new)
        none = self.nodes.select("id", F.col("id").alias("above"), F.lit(0).alias("distance")).where("false")
        return reduce(DataFrame.unionByName, parts, none)

    def leaves(self) -> DataFrame:
        """(id, leaf, distance) of all nodes and the leaves below them, each pair made once; a leaf is its own."""
        parts = [self.nodes.where("leaf").select("id", F.col("id").alias("leaf"), F.lit(0).alias("distance"))]
        for k, jump in enumerate(self.jumps):
            known = reduce(DataFrame.unionByName, parts)
            parts.append(kept(jump.join(known, "id").select(F.col("up").alias("id"), "leaf", (F.col("distance") + (1 << k)).alias("distance")), "leaves"))
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def labels(self) -> DataFrame:
        """Nodes with top (their root's id), depth, pre (place in the order parent, first side, second side), size (nodes from here down), low and many: their leaves are low to low + many - 1.

        ``enter`` and ``leave`` are their places in a walk that passes each node twice. A node stands below another of its tree where its pre lies in that one's pre + 1 to pre + size - 1.
        """
        one = self.nodes.select("id", F.lit(1).cast("long").alias("size"), F.col("leaf").cast("long").alias("many"))
        sizes = self.fold(one, {"size": F.sum, "many": F.sum})
        first = self.nodes.where("side = 0").select("project", F.col("node").alias("sibling"), "id").join(sizes, "id").select("project", "sibling", F.col("size").alias("_size"), F.col("many").alias("_many"))
        rows = self.nodes.join(sizes, "id").join(first, ["project", "sibling"], "left")  # a first side's sibling is a second one, which isn't in the table
        below = F.col("parent").isNotNull().cast("long")
        steps = kept(rows.withColumns({"depth": below, "pre": below + F.coalesce("_size", F.lit(0)), "low": F.coalesce("_many", F.lit(0))}).drop("_size", "_many"), "steps")
        sums = self.climb(steps, "depth", "pre", "low")
        out = steps.drop("depth", "pre", "low").join(sums, "id").withColumn("enter", 2 * F.col("pre") - F.col("depth"))
        return kept(out.withColumn("leave", F.col("enter") + 2 * F.col("size") - 1), "labels")


def chain_ends(pointers: DataFrame, *group: str) -> DataFrame:
    """(group, node, end) of (group, node, to): where following the pointers ends."""
    now = kept(pointers.select(*group, "node", "to"), "chains")
    rounds, n = 0, now.count()
    while True:
        step = now.select(*group, F.col("node").alias("to"), F.col("to").alias("_to"))
        both = kept(now.join(step, [*group, "to"], "left").select(*group, "node", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("_more")), "chains")
        if not both.agg(F.max("_more")).first()[0]:
            return both.select(*group, "node", F.col("to").alias("end"))
        rounds += 1
        if 1 << (rounds - 1) > max(1, n):
            raise ValueError("the pointers have a cycle")
        now = both.drop("_more")
