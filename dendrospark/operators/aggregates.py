"""Aggregations over clusters, annotations and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dendrospark.functions import scalar as fn
from dendrospark.operators.storage import FEW, dealt, kept


def composition(rows: DataFrame, key: str, order: str, family: str, name: str = "mda") -> DataFrame:
    """The families of each key in order, joined; ``unknown`` for a missing one."""
    fam = F.coalesce(F.col(family).cast("string"), F.lit("unknown"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), fam.alias("f"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["f"]), "-").alias(name))


def mean_pool(rows: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """The mean vector of each key; positions beyond a vector's end don't count."""
    each = rows.select(key, F.posexplode(vector).alias("_i", "_x"))
    means = each.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    parts = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(key).agg(F.transform(parts, lambda p: p["_m"]).alias(name))


def best_hit(hits: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    return hits.groupBy(*keys).agg(F.min(score).alias(score))


def symmetrised(scores: DataFrame) -> DataFrame:
    """Each score from both of its ends."""
    return scores.select("project", F.col("id1").alias("id"), F.col("id2").alias("partner"), "score").unionByName(
        scores.select("project", F.col("id2").alias("id"), F.col("id1").alias("partner"), "score")
    )


def nearest(scores: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Lowest score and partner of each id; ties go to the smaller partner. ``ids`` without scores get (null, inf)."""
    best = symmetrised(scores).groupBy("project", "id").agg(F.min(F.struct("score", "partner")).alias("b"))
    best = best.select("project", "id", F.col("b.partner").alias("partner"), F.col("b.score").alias("score"))
    if ids is None:
        return best
    return ids.join(best, ["project", "id"], "left").select("project", "id", "partner", F.coalesce("score", F.lit(float("inf"))).alias("score"))


def global_nearest(scores: DataFrame) -> DataFrame:
    """The lowest pair of each project."""
    low = scores.groupBy("project").agg(F.min(F.struct("score", "id1", "id2")).alias("b"))
    return low.select("project", "b.id1", "b.id2", "b.score")


def mean_linkage(members: DataFrame, distances: DataFrame, pairs: DataFrame | None = None, missing_as_zero: bool = False) -> DataFrame:
    """Mean distance of all member pairs of two clusters.

    ``members``: project, cluster, id. ``distances``: project, id1, id2, dist, each pair once.
    By default pairs without a distance don't count; with ``missing_as_zero`` they count as 0.
    """
    left = members.select("project", F.col("cluster").alias("ca"), F.col("id").alias("id1"))
    right = members.select("project", F.col("cluster").alias("cb"), F.col("id").alias("id2"))
    both = distances.join(left, ["project", "id1"]).join(right, ["project", "id2"]).where("ca <> cb")
    out = both.groupBy("project", F.least("ca", "cb").alias("id1"), F.greatest("ca", "cb").alias("id2")).agg(F.sum("dist").alias("total"), F.count("dist").alias("n"))
    if missing_as_zero:
        size = members.groupBy("project", "cluster").agg(F.count("*").alias("size"))
        for i in (1, 2):
            out = out.join(size.select("project", F.col("cluster").alias(f"id{i}"), F.col("size").alias(f"n{i}")), ["project", f"id{i}"])
        out = out.withColumn("n", F.col("n1") * F.col("n2")).drop("n1", "n2")
    out = out.withColumn("score", F.col("total") / F.col("n"))
    return out if pairs is None else out.join(pairs, ["project", "id1", "id2"], "left_semi")


def geometric_mean(score: Column) -> Column:
    return F.exp(F.avg(F.log(fn.score_clamp(score))))


def term_counts(rows: DataFrame, item: str, term: str) -> DataFrame:
    """In how many items each term stands."""
    return rows.select(item, term).distinct().groupBy(term).agg(F.count("*").alias("n"))


def term_counts_with_ancestors(rows: DataFrame, closure: DataFrame, item: str, term: str) -> DataFrame:
    """Each item counts for its terms and all their ancestors, once."""
    own = rows.select(item, F.col(term).alias("term"))
    up = own.join(closure.select(F.col("child").alias("term"), "ancestor"), "term").select(item, F.col("ancestor").alias("term"))
    return term_counts(own.unionByName(up), item, "term")


def collected(rows: DataFrame, key: str, term: str, name: str, none: str = "none") -> DataFrame:
    """Sorted distinct terms of each key as text; ``none`` where there are none."""
    text = fn.terms_text(F.array_sort(F.collect_set(term)))
    return rows.groupBy(key).agg(F.when(text == "", F.lit(none)).otherwise(text).alias(name))


def spread_join(rows: DataFrame, own: DataFrame, key: str, by: str, few: int = FEW, part: int = 1 << 20) -> DataFrame:
    """``rows`` with each row of ``own`` (written, so that it can be counted) of equal ``key``, where a few keys may have most rows.

    Up to ``few`` rows of ``own`` are sent to every task. Of more, a key's ``rows`` are dealt by ``by`` to parts of about ``part`` rows, and ``own`` is copied for each part of its key.
    """
    if own.count() <= few:
        return rows.join(F.broadcast(own), key)
    parts = rows.groupBy(key).agg(F.ceil(F.count("*") / part).cast("int").alias("_parts")).where("_parts > 1")
    split = kept(parts, "large-keys")
    n = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(split), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), n).cast("int")).drop("_parts")
    copied = own.join(F.broadcast(split), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def annotation_transfer(terms: DataFrame, codes: DataFrame, reliable: DataFrame, few: int = FEW, part: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Terms that go with a code are added to its items; a code whose whole term set an item has is added to it.

    ``terms``: item, term. ``codes``: item, code. ``reliable``: term. ``few``, ``part``: as in ``spread_join``.
    """
    seen = kept(codes.join(terms, "item").join(reliable, "term", "left_semi").select("code", "term").distinct(), "seen")
    more_terms = spread_join(codes, seen, "code", "item", few, part).select("item", "term").unionByName(terms).distinct()
    size = seen.groupBy("code").agg(F.count("*").alias("need"))
    has = spread_join(dealt(terms, "item", rows=part).distinct(), seen, "term", "item", few, part).groupBy("item", "code").agg(F.count("*").alias("has"))
    more_codes = has.join(size, "code").where("has = need").select("item", "code").unionByName(codes).distinct()
    return more_terms, more_codes


def cluster_sizes(rows: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n): rows of each."""
    return rows.groupBy(cluster).agg(F.count("*").alias("n"))


def size_summary(sizes: DataFrame, cluster: str) -> DataFrame:
    """total, and the largest cluster with its size (the smallest name of equal ones); nulls if there is none."""
    most = F.max(F.struct("n", F.lit(0).alias("_")))["n"]
    top = sizes.agg(F.sum("n").alias("total"), most.alias("largest"))
    name = sizes.join(F.broadcast(top), F.col("n") == F.col("largest")).agg(F.min(cluster).alias(cluster))
    return top.join(F.broadcast(name))  # a row each


def length_stats(rows: DataFrame, key: str, length: Column) -> DataFrame:
    """(key, mean, least, most) of a length."""
    return rows.groupBy(key).agg(F.round(F.avg(length), 6).alias("mean"), F.min(length).alias("least"), F.max(length).alias("most"))


def length_mean(rows: DataFrame, key: str, length: Column) -> DataFrame:
    """(key, n, mean) of a length."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(length), 6).alias("mean"))


def length_spread(rows: DataFrame, key: str, length: Column) -> DataFrame:
    """(key, spread): 100 times the longest over the shortest."""
    return rows.groupBy(key).agg(F.round(100.0 * F.max(length) / F.min(length), 6).alias("spread"))


def code_counts(rows: DataFrame, cluster: str, code: str) -> DataFrame:
    """(cluster, code, n): how often each cluster has each code."""
    return rows.groupBy(cluster, code).agg(F.count("*").alias("n"))


def distinct_families(rows: DataFrame, *family: str) -> DataFrame:
    return rows.select(*family).distinct()


def first_accessions(rows: DataFrame, accession: str, *key: str, order: str | None = None, name: str = "acc") -> DataFrame:
    """Of each key, the accession that is first by ``order`` (default: the smallest)."""
    return rows.groupBy(*key).agg(F.min_by(accession, order or accession).alias(name))


def row_count(rows: DataFrame, name: str = "n") -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def filter_terms(terms: DataFrame, known: DataFrame, key: str, types: str, deny: list[str]) -> DataFrame:
    """(key, valid, invalid): how many of a key's terms have a wanted type and are, or aren't, outside ``deny``; unknown terms are dropped.

    ``known`` has term and type; ``types`` is a pattern.
    """
    mine = terms.join(known.where(F.col("type").rlike(types)).select("term"), "term")
    denied = F.col("term").isin(deny)
    return mine.groupBy(key).agg(F.count(F.when(~denied, 1)).alias("valid"), F.count(F.when(denied, 1)).alias("invalid"))
