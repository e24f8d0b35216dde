"""Numbering, chunking and running conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dendrospark.functions import scalar as fn
from dendrospark.operators.storage import kept


def dense_rank_over_all(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in the order of ``keys`` over the whole table, without one task that holds it.

    Rows are sorted by range, numbered inside each range, and moved on by the rows before the range.
    """
    ranged = kept(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part").orderBy(*keys)
    return (
        ranged.withColumn(name, F.row_number().over(own).cast("long")).join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")
    )


def numbered(df: DataFrame, groups: Sequence[str], keys: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 1 in the order of ``keys`` in each of ``groups``, without a task that holds a group.

    As ``dense_rank_over_all``, with the rows before a range summed by group: of each a row a range that it reaches into.
    """
    order = [*map(F.col, groups), *keys]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = kept(ranged, "ranges").withColumns({"_part": F.shiftrightunsigned("_m", 33), "_in": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    cells = ranged.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = ranged.join(bases, same).withColumn(name, (F.col("_in") + F.col("_base")).cast("long"))
    return out.drop("_m", "_part", "_in", "_p", "_base", *[f"_g{i}" for i in range(len(groups))])


def renumber(df: DataFrame, group: str, order: Sequence[Column], name: str = "working_id", prefix: str = "working_", offset: Column | int = 0) -> DataFrame:
    """``working_1`` and on in each group, after ``offset`` that are there already."""
    return numbered(df, [group], order, "_n").withColumn(name, F.concat(F.lit(prefix), (F.col("_n") + offset).cast("string"))).drop("_n")


def partition_projects(sizes: DataFrame, key: str, count: str, least: int = 1000) -> DataFrame:
    """Large compositions get project 1, 2, ... by size; all others share the next number."""
    large = sizes.where(F.col(count) >= least)
    own = dense_rank_over_all(large, [F.desc(count), F.col(key)], "project").withColumn("project", F.col("project").cast("int"))
    pooled = sizes.where(F.col(count) < least)
    n = large.agg(F.count("*").alias("_n"))
    return own.select(*sizes.columns, "project").unionByName(pooled.join(F.broadcast(n)).withColumn("project", (F.col("_n") + 1).cast("int")).drop("_n"))


def running_cut(merges: DataFrame, threshold: float, project: str = "project", step: str = "step", score: str = "score") -> DataFrame:
    """Merges before the first that exceeds the threshold, in each project."""
    end = merges.groupBy(project).agg(F.min(F.when(F.col(score) > threshold, F.col(step))).alias("_end"))
    return merges.join(end, project).where(F.col("_end").isNull() | (F.col(step) < F.col("_end"))).select(*merges.columns)


def chunks(df: DataFrame, size: int, group: str, order: Sequence[Column], name: str = "chunk") -> DataFrame:
    return numbered(df, [group], order, "_n").withColumn(name, F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def ordered_pairs(merges: DataFrame, project: str = "project") -> DataFrame:
    """Children of each merge, the one created earlier first; a leaf comes before a merged node, leaves in natural order."""
    birth = merges.select(project, F.col("parent").alias("node"), F.col("step").alias("birth"))

    def born(df: DataFrame, child: str, name: str) -> DataFrame:
        b = birth.select(project, F.col("node").alias(child), F.col("birth").alias(name))
        return df.join(b, [project, child], "left").withColumn(name, F.coalesce(name, F.lit(-1)))

    both = born(born(merges, "child_a", "_a"), "child_b", "_b")
    key = lambda c, b: F.struct(F.col(b), fn.natural_key(F.col(c).cast("string")))
    flip = key("child_b", "_b") < key("child_a", "_a")
    return both.withColumns(
        {"first": F.when(flip, F.col("child_b")).otherwise(F.col("child_a")), "second": F.when(flip, F.col("child_a")).otherwise(F.col("child_b"))}
    ).drop("_a", "_b")


def merge_runs(domains: DataFrame, families: Sequence[str], protein: str = "protein", max_gap: int = 10) -> DataFrame:
    """Where consecutive domains match the family list, one domain of their merged segments; others stay as they are.

    ``domains``: protein, start, stop, family. A run that doesn't match is tried again from its next domain;
    of overlapping runs the earlier is taken.
    """
    k = len(families)
    order = Window.partitionBy(protein).orderBy("start", "stop", "family")
    fits = F.lit(True)
    for i, f in enumerate(families):
        fits = fits & (F.lead("family", i).over(order) == f if i else F.col("family") == f)
    segs = F.array(*[F.struct((F.lead("start", i).over(order) if i else F.col("start")).cast("int").alias("start"), (F.lead("stop", i).over(order) if i else F.col("stop")).cast("int").alias("stop")) for i in range(k)])
    marked = domains.withColumns({"_at": F.row_number().over(order), "_fits": F.coalesce(fits, F.lit(False)), "_segs": segs})
    own = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.col("_at"))))
    taken = marked.groupBy(protein).agg(own.alias("_starts")).withColumn(
        "_taken",
        F.aggregate("_starts", F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (x >= F.element_at(acc, -1) + k), F.concat(acc, F.array(x))).otherwise(acc)),
    )
    rows = marked.join(taken.select(protein, "_taken"), protein)
    inside = F.exists("_taken", lambda t: (F.col("_at") >= t) & (F.col("_at") < t + k))
    head = F.array_contains("_taken", F.col("_at"))
    merged = rows.where(head).select(protein, F.lit("-".join(families)).alias("family"), fn.merge_segments(F.col("_segs"), max_gap).alias("segments"))
    other = rows.where(~inside).select(protein, "family", F.array(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))).alias("segments"))
    return merged.unionByName(other)
