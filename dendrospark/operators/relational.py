"""Filters, joins, set operations, sorts and samples."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dendrospark.functions import scalar as fn
from dendrospark.operators.intervals import containing, depth_at
from dendrospark.operators.storage import kept
from dendrospark.operators.windows import numbered

# filters --------------------------------------------------------------------------------


def domain_filter(domains: DataFrame, max_evalue: float = 0.001, families: list[str] | None = None, taxon: int | None = None, source: str | None = None) -> DataFrame:
    """Domains below the e-value limit, of given families (default: any known) and taxon (default: any known)."""
    keep = F.col("evalue") < max_evalue
    keep = keep & (F.col("family").isin(families) if families else F.col("family").isNotNull())
    keep = keep & (F.col("taxon") == taxon if taxon is not None else F.col("taxon").isNotNull())
    return domains.where(keep & (F.col("source") == source) if source else keep)


def annotated_clusters(members: DataFrame, evidence: DataFrame, allowed: tuple[str, ...] = (), fallback: tuple[str, ...] = ()) -> DataFrame:
    """Clusters with a member whose evidence is neither ``N...`` nor ``IEA:`` (unless allowed).

    In projects where none is left, the ``fallback`` evidences count too.
    """
    code = F.col("evidence")

    def good(ok: tuple[str, ...]) -> DataFrame:
        fine = (~code.startswith("N")) & ((~code.startswith("IEA:")) | code.isin(list(ok)))
        return members.join(evidence.where(fine), "item", "left_semi").select("project", "cluster").distinct()

    first = good(allowed)
    return first.unionByName(good(allowed + fallback).join(first.select("project").distinct(), "project", "left_anti"))


def gaf_quality(rows: DataFrame, accessions: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Association rows fit for use: database UniProtKB, a known accession, no qualifier, and either not IEA, or IEA of a
    reviewed accession from source 3 (its EC is kept), 37 or 38."""
    base = rows.where((F.col("db") == "UniProtKB") & (F.coalesce("qualifier", F.lit("")) == "")).join(accessions, "acc", "left_semi")
    base = base.join(reviewed.select("acc").distinct().withColumn("_rev", F.lit(True)), "acc", "left")
    fine = (F.col("evidence") != "IEA") | (F.coalesce("_rev", F.lit(False)) & F.col("source").isin("3", "37", "38"))
    ec = F.when((F.col("evidence") == "IEA") & (F.col("source") == "3"), F.col("ec"))
    return base.where(fine).withColumn("ec", ec).drop("_rev")


def annotation_guard(rows: DataFrame, project: str = "project", item: str = "item", term: str = "term", most: int = 1_000_000) -> DataFrame:
    """Without ``none`` and over-annotated items; nothing of a project with fewer than two distinct terms."""
    known = rows.where(F.col(term) != "none")
    few = known.groupBy(project, item).agg(F.countDistinct(term).alias("n")).where(F.col("n") <= most)
    kept_rows = known.join(few.drop("n"), [project, item], "left_semi")
    two = kept_rows.groupBy(project).agg(F.countDistinct(term).alias("n")).where("n >= 2")
    return kept_rows.join(two.select(project), project, "left_semi")


def size_range(rows: DataFrame, sizes: DataFrame, key: str, low: int, high: int) -> DataFrame:
    return rows.join(sizes.where(F.col("size").between(low, high)), key, "left_semi")


def not_done(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Work that isn't done, each request once."""
    return work.dropDuplicates(list(keys)).join(done, list(keys), "left_anti")


def drop_retired(scores: DataFrame, retired: DataFrame) -> DataFrame:
    """Scores with neither end among the retired (project, id)."""
    for end in ("id1", "id2"):
        scores = scores.join(retired.select("project", F.col("id").alias(end)), ["project", end], "left_anti")
    return scores.select("project", "id1", "id2", *[c for c in scores.columns if c not in ("project", "id1", "id2")])


def scores_within(scores: DataFrame, live: DataFrame, cutoff: float) -> DataFrame:
    out = scores.where(F.col("score") <= cutoff)
    for end in ("id1", "id2"):
        out = out.join(live.select("project", F.col("id").alias(end)), ["project", end], "left_semi")
    return out


def split_failed(rows: DataFrame, error: str = "_error") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def visible(names: DataFrame, name: str) -> DataFrame:
    return names.where(~F.col(name).startswith("."))


def seqid_filter(records: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    return records.join(ids, key, "left_semi" if keep else "left_anti")


# joins ----------------------------------------------------------------------------------


def mapped_ids(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` replaced through (old, new); an id without a mapping is an error."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    error = F.raise_error(F.concat(F.lit("no mapping for "), F.col(column).cast("string")))
    new = F.when(F.col("_new").isNull(), error.cast(mapping.schema["new"].dataType)).otherwise(F.col("_new"))
    return rows.join(m, column, "left").withColumn(column, new).drop("_new")


#: Items of a project on one side of a tile, and pairs that a task is to make, about.
TILE, TASK_PAIRS = 1024, 1 << 19


def tiled(left: DataFrame, right: DataFrame, by: tuple[str, str], tile: int = TILE) -> DataFrame:
    """Each row of ``left`` with each of ``right`` of its project, a tile of both a group: a large project is dealt as many tiles, each row going to those of its strip.

    Tiles are dealt to a number of tasks that follows the number of pairs, counted first: the rows that make them are few, and by their bytes one task would get them all.
    ``by``: a column of each side that spreads its rows over strips. Projects that only one side has get no rows. Other names must differ.
    """
    strips = lambda df, name: df.groupBy("project").agg(F.ceil(F.count("*") / tile).cast("int").alias(name), F.count("*").cast("double").alias(f"{name}_rows"))
    both = strips(left, "_ln").join(strips(right, "_rn"), "project")
    tasks = min(4096, max(1, math.ceil((both.agg(F.sum(F.col("_ln_rows") * F.col("_rn_rows"))).first()[0] or 0) / TASK_PAIRS)))
    both = both.drop("_ln_rows", "_rn_rows")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(both, "project").withColumn("_li", own(by[0], "_ln")).withColumn("_ri", every("_rn"))
    b = right.join(both, "project").withColumn("_ri", own(by[1], "_rn")).withColumn("_li", every("_ln"))
    # one text of all three as the key: where the project is a constant, three would lose it and be dealt anew, by their bytes
    a, b = (x.withColumn("_tile", F.to_json(F.struct("project", "_li", "_ri"))).drop("_ln", "_rn", "_li", "_ri").repartition(tasks, "_tile") for x in (a, b))
    return a.join(b.drop("project").hint("shuffle_hash"), "_tile").drop("_tile")


def all_pairs(items: DataFrame, order: str, *values: str, with_self: bool = False, tile: int = TILE) -> DataFrame:
    """The upper triangle of each project's items: columns of the left with 1, of the right with 2."""
    a = items.select("project", *[F.col(c).alias(f"{c}1") for c in (order, *values)])
    b = items.select("project", *[F.col(c).alias(f"{c}2") for c in (order, *values)])
    x, y = F.col(f"{order}1"), F.col(f"{order}2")
    return tiled(a, b, (f"{order}1", f"{order}2"), tile).where(x <= y if with_self else x < y)


def triangle_complete(pairs: DataFrame, hits: DataFrame, missing: float = 0.02, name: str = "dist") -> DataFrame:
    """Each pair's own hit, else the reverse hit, else ``missing``; 0 to itself."""
    forward = hits.select("id1", "id2", F.col("value").alias("_f"))
    reverse = hits.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.col("value").alias("_r"))
    out = pairs.join(forward, ["id1", "id2"], "left").join(reverse, ["id1", "id2"], "left")
    value = F.when(F.col("id1") == F.col("id2"), F.lit(0.0)).otherwise(F.coalesce("_f", "_r", F.lit(missing)))
    return out.withColumn(name, value).drop("_f", "_r")


def _lives(births: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges and nodes with ``most``, their project's last step; a node lives from ``first`` to before ``end``."""
    last = merges.groupBy("project").agg(F.max("step").cast("long").alias("most"))
    lives = births.join(last, "project").select("project", "node", (F.col("birth") + 1).alias("first"), F.coalesce("death", F.col("most") + 1).alias("end"), "most")
    return merges.select("project", "step", "parent").join(last, "project"), lives


def alive_at(births: DataFrame, merges: DataFrame) -> DataFrame:
    """For each merge, the nodes made before it and not merged up to it, other than its parent.

    ``births``: project, node, birth (-1 or more), death (null: never). Steps aren't negative.
    """
    points, lives = _lives(births, merges)
    return containing(points, "step", lives, "first", "end", ["project"]).select("project", "step", "parent", F.col("node").alias("other"))


def alive_counts(births: DataFrame, merges: DataFrame) -> DataFrame:
    """How many nodes ``alive_at`` gives for each merge, without making them."""
    points, lives = _lives(births, merges)
    return depth_at(points, "step", lives, "first", "end", ["project"]).select("project", "step", "parent", "n")


def score_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two score tables side by side on the unordered pair, 0 where one has none; of repeats the later (``ord``) counts."""

    def one(df: DataFrame, name: str) -> DataFrame:
        lo, hi = fn.canonical_pair(F.col("id1"), F.col("id2"))
        return df.groupBy(lo.alias("id1"), hi.alias("id2")).agg(F.max_by("score", "ord").alias(name))

    both = one(a, "score_a").join(one(b, "score_b"), ["id1", "id2"], "full")
    return both.select("id1", "id2", F.coalesce("score_a", F.lit(0.0)).alias("score_a"), F.coalesce("score_b", F.lit(0.0)).alias("score_b"))


def score_triples(scores: DataFrame, side: int = 512) -> DataFrame:
    """Ordered triples of distinct items whose three scores are all there.

    Items fall into strips of about ``side``; a pair goes to the tiles of its two strips and each third, so pairs are copied by the number of strips and pairs of pairs are never rows.
    A triangle is found once, in the tile of its strips, and becomes its six orders. Strips are a project's where each item has one project.
    """
    ends = F.explode(F.array("id1", "id2")).alias("id")
    project = F.col("project") if "project" in scores.columns else F.lit(0)
    pairs = scores.where("id1 <> id2").select(project.alias("project"), "id1", "id2", "score")
    items = kept(pairs.select("project", ends).distinct(), "items")
    if items.count() > items.select("id").distinct().count() or items.where("project IS NULL").count():
        pairs = pairs.withColumn("project", F.lit(0))
        items = items.select(F.lit(0).alias("project"), "id").distinct()
    strips = items.groupBy("project").agg(F.ceil(F.count("*") / side).cast("int").alias("_n"))
    own = lambda c: F.struct(F.pmod(F.xxhash64(c), F.col("_n")).cast("int").alias("s"), F.col(c).alias("id"))
    pairs = pairs.join(F.broadcast(strips), "project").select("project", F.least(own("id1"), own("id2")).alias("x"), F.greatest(own("id1"), own("id2")).alias("y"), "score", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_third"))
    tile = F.array_sort(F.array("x.s", "y.s", "_third"))
    pairs = pairs.withColumn("_t", tile)
    stands = sum((F.when((F.col("x.s") == F.col("_t")[i]) & (F.col("y.s") == F.col("_t")[j]), F.lit(1 << at)).otherwise(F.lit(0)) for at, (i, j) in enumerate(((0, 1), (1, 2), (0, 2)))), F.lit(0))
    rows = pairs.select(F.concat_ws("/", "_t", F.col("project").cast("string")).alias("tile"), stands.cast("byte").alias("stands"), F.col("x.id").alias("id1"), F.col("y.id").alias("id2"), "score")
    n = strips.agg(F.sum(F.col("_n") * (F.col("_n") + 1) * (F.col("_n") + 2) / 6)).first()[0] or 1
    names = ["x", "y", "z", "xy", "yz", "xz"]

    def triangles(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Of one tile's pairs, those of its first two strips, its last two, and the first and last."""
        sides = xy, yz, xz = [pdf[pdf["stands"] & (1 << at) > 0] for at in range(3)]
        if any(e.duplicated(["id1", "id2"]).any() for e in sides):  # a pair with several scores counts with each
            xy, yz, xz = (e[["id1", "id2", "score"]].set_axis([*k, k], axis=1) for e, k in zip(sides, ("xy", "yz", "xz")))
            yield xy.merge(yz, on="y").merge(xz, on=["x", "z"])[names]
            return
        ids = [np.unique(np.concatenate(c)) for c in ((xy["id1"], xz["id1"]), (xy["id2"], yz["id1"]), (yz["id2"], xz["id2"]))]
        value, there = {}, {}
        for name, e, i, j in (("xy", xy, 0, 1), ("yz", yz, 1, 2), ("xz", xz, 0, 2)):
            at = np.searchsorted(ids[i], e["id1"]), np.searchsorted(ids[j], e["id2"])
            value[name], there[name] = np.full((len(ids[i]), len(ids[j])), np.nan), np.zeros((len(ids[i]), len(ids[j])), dtype=bool)
            value[name][at], there[name][at] = e["score"], True
        held, size = [], 0
        for y in range(len(ids[1])):
            x, z = np.flatnonzero(there["xy"][:, y]), np.flatnonzero(there["yz"][y])
            i, j = np.nonzero(there["xz"][np.ix_(x, z)])
            if len(i):
                i, j = x[i], z[j]
                held.append((ids[0][i], np.repeat(ids[1][y], len(i)), ids[2][j], value["xy"][i, y], value["yz"][y, j], value["xz"][i, j]))
                size += len(i)
            if size > 1 << 18 or (size and y == len(ids[1]) - 1):
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))
                held, size = [], 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            for tile, part in pdf.groupby("tile", sort=False):
                if rest and rest[0]["tile"].iloc[0] != tile:
                    yield from triangles(pd.concat(rest, ignore_index=True))
                    rest = []
                rest.append(part)
        if rest:
            yield from triangles(pd.concat(rest, ignore_index=True))

    kind = scores.schema["id1"].dataType.simpleString()
    found = rows.repartition(min(4096, int(n)), "tile").sortWithinPartitions("tile").mapInPandas(run, f"x {kind}, y {kind}, z {kind}, xy double, yz double, xz double")
    orders = [F.struct(*[F.col(c if c in names else c[::-1]).alias(k) for c, k in zip((p, q, r, p + q, q + r, p + r), ("a", "b", "c", "ab", "bc", "ac"))]) for p, q, r in permutations("xyz")]
    return found.select(F.inline(F.array(*orders)))


def pair_lookup(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    lo, hi = fn.canonical_pair(F.col("id1"), F.col("id2"))
    known = scores.select(lo.alias("_lo"), hi.alias("_hi"), "score")
    return pairs.withColumns({"_lo": lo, "_hi": hi}).join(known, ["_lo", "_hi"], "left").drop("_lo", "_hi")


def refill_members(headers: DataFrame, members: DataFrame) -> DataFrame:
    """Each header replaced by all members of its cluster. ``headers``: node, item. ``members``: cluster, item."""
    own = members.select("item", "cluster")
    return headers.join(own, "item").select("node", "cluster").distinct().join(members, "cluster").select("node", "item")


# sets -----------------------------------------------------------------------------------


def override_union(main: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """All of ``extra``, and of ``main`` what ``extra`` has no key of."""
    return extra.unionByName(main.join(extra.select(key), key, "left_anti").select(*main.columns))


def upsert(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``existing``, and of ``new`` what it has no keys of."""
    return existing.unionByName(new.join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))


# sorts and samples ----------------------------------------------------------------------


def sample_count(left: int, fraction: float, low: int = 2_000_000, high: int = 10_000_000) -> int:
    """Pairs of a round: a fraction of those left, within bounds, and no more than are left."""
    return min(left, max(low, min(high, int(left * fraction))))


#: Rows that one task may sort, and sampled rows that find where larger samples end.
ONE_TASK, PIVOTS = 100_000, 20_000


def sample_pairs(pairs: DataFrame, rows: int, order: Column, one_task: int = ONE_TASK) -> DataFrame:
    """``rows`` pairs without replacement, those that come first in ``order`` (a hash of the pair).

    Beyond ``one_task`` rows they come in no order: a value just beyond the last of them, found in a random sample, leaves out most others (all stay if it proves too low), and
    the rest are numbered by ranges.
    """
    if rows <= one_task:
        return pairs.orderBy(order, *pairs.columns).limit(rows)
    sure = PIVOTS + math.ceil(6 * math.sqrt(PIVOTS))
    first = pairs.select(order.alias("_o")).sample(min(1.0, PIVOTS / rows), seed=1).orderBy("_o").limit(sure)
    n, end = first.agg(F.count("*"), F.max("_o")).first()
    if n == sure:
        near = kept(pairs.where(order.isNull() | (order <= F.lit(end))), "near")
        pairs = near if near.count() >= rows else pairs
    return numbered(pairs, [], [order, *map(F.col, pairs.columns)], "_n").where(F.col("_n") <= rows).drop("_n")


def centre_pairs(ids: DataFrame, order: Column, least: int = 10, share: int = 100) -> DataFrame:
    """max(least, n / share) centres of each project by ``order``, each with every other id that isn't a centre."""
    n = ids.groupBy("project").agg(F.count("*").alias("_n"))
    marked = kept(numbered(ids, ["project"], [order, F.col("id")], "_at").join(n, "project").select("project", "id", (F.col("_at") <= F.greatest(F.lit(least), F.floor(F.col("_n") / share))).alias("centre")), "centres")
    a = marked.where("centre").select("project", F.col("id").alias("id1"))
    return tiled(a, marked.where("not centre").select("project", F.col("id").alias("id2")), ("id1", "id2"))


def first_rows(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """At most ``most`` rows of each project. Where they are few, each task leaves only that many of what it has before rows are shuffled (up to 1,000, by Spark's default)."""
    if most > 1000:
        return numbered(rows, ["project"], order, "_n").where(F.col("_n") <= most).drop("_n")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def with_details(rows: DataFrame, *tables: tuple[DataFrame, str, str]) -> DataFrame:
    """``rows`` with the columns of tables (table, its key, the rows' key); rows without a match in all of them are dropped."""
    for other, own, key in tables:
        rows = rows.join(other, F.col(own) == F.col(key))
    return rows


def first_matches(ids: DataFrame, rows: DataFrame, id_: str, key: str, value: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, first): the first ``value`` of the rows whose ``key`` is the id; and the ids that no row has."""
    both = ids.select(id_).distinct().join(rows, F.col(id_) == F.col(key))
    found = both.groupBy(id_).agg(F.min_by(value, order or value).alias("first"))
    return found, ids.select(id_).distinct().join(rows.select(F.col(key).alias(id_)), id_, "left_anti")


def id_mapping(rows: DataFrame, wanted: DataFrame, key: str, *tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows whose key is wanted, with the columns of tables as ``with_details`` takes them."""
    return with_details(rows.join(wanted.select(key), key, "left_semi"), *tables)


def joined_terms(accessions: DataFrame, terms: DataFrame, own: str, key: str, id_: str, term: str) -> DataFrame:
    """Distinct (id, term) of accessions and the terms of each."""
    return accessions.join(terms, F.col(own) == F.col(key)).select(id_, F.col(term).alias("term")).distinct()


def of_annotated(rows: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that a marked row has."""
    return rows.join(marked.select(key), key, "left_semi")


def cluster_annotations(clusters: DataFrame, annotations: DataFrame, item: str, *columns: str) -> DataFrame:
    return clusters.join(annotations, item).select(*columns)


def in_list(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the list, each once however often it is listed."""
    return rows.join(ids.select(key), key, "left_semi")


def sorted_scores(scores: DataFrame, low: float, high: float) -> DataFrame:
    """Scores up to ``low`` and above ``high``, in order."""
    return scores.where((F.col("score") <= low) | (F.col("score") > high)).orderBy("score", "id1", "id2")


def value_sorted(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.orderBy(*order)


def row_limit(rows: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in order."""
    return rows.orderBy(*order).limit(n)


def shuffled(rows: DataFrame, key: str, seed: int | str) -> DataFrame:
    """``rows`` with ``place``, a digest of key and seed, in its order: a repeatable shuffle."""
    return rows.withColumn("place", F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))).orderBy("place")


def union_distinct(*tables: DataFrame) -> DataFrame:
    return union_all(*tables).distinct()


def union_all(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, columns by name."""
    return reduce(DataFrame.unionByName, tables)


def pool_mappings(*mappings: DataFrame) -> DataFrame:
    """Mappings (columns alike) as one, each pair once."""
    return union_distinct(*mappings)
