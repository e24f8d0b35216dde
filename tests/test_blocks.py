"""Clusterings on tiles, with strips small enough for several rounds, against one merge (or bundle) at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dendrospark.operators import blocks
from dendrospark.operators import cluster as cl
from dendrospark.operators import hierarchy as h

ITEMS = "project int, id long, embedding array<float>"


def vectors(n, spread):
    rng = random.Random(n)
    return [(p, i * 3 % 1009, [rng.gauss(0, spread) for _ in range(3)]) for p in (1, 2) for i in range(1, n + 1 - 9 * p)]


def tree(rows, of, bundle=False, tops=None):
    """Leaves and score of each merge of the items of one project."""
    members, d, out = {i: [i] for _, i, _ in rows}, {}, []
    at = {i: v for _, i, v in rows}
    for i in at:
        for j in at:
            d[i, j] = round(math.dist([*map(float, at[i])], [*map(float, at[j])]), 6)
    tops = list(tops or [math.inf])
    while len(members) > 1 and tops:
        links = sorted((of([d[i, j] for i in members[a] for j in members[b]]), a, b) for a in members for b in members if a < b)
        top = 10.0 ** (10 * math.ceil(math.log10(links[0][0]) / 10)) if bundle else tops[0]
        used = set()
        for x, a, b in links if bundle or tops[0] < math.inf else links[:1]:
            if x <= top and not used & {a, b}:
                used |= {a, b}
                out.append((tuple(sorted(members[a] + members[b])), round(x, 6)))
                members[a] = members[a] + members.pop(b)
        if not used:
            tops.pop(0)
    return out


def found(merges):
    merges = cl.kept(merges)
    below = {(r.project, r.node): tuple(sorted(map(int, r.l))) for r in h.leaves(merges).groupBy("project", "node").agg(F.collect_set("leaf").alias("l")).collect()}
    return {p: [(below[p, r.parent], round(r.score, 6)) for r in sorted(merges.where(F.col("project") == p).collect(), key=lambda r: r.step)] for p in (1, 2)}


MEAN = lambda v: math.fsum(v) / len(v)
WAYS = {"complete": max, "rescored": MEAN, "windowed": MEAN, "geomean": lambda v: 10 ** MEAN(list(map(math.log10, v)))}


@pytest.fixture(scope="module")
def rows(spark):
    made = vectors(33, 2.0)
    return [tuple(r) for r in spark.createDataFrame(made, ITEMS).collect()]


@pytest.mark.parametrize("policy", list(WAYS))
def test_vectors_by_tiles(spark, rows, policy):
    got = found(cl.cluster_vectors(spark.createDataFrame(rows, ITEMS), policy, 6, side=4))
    for p in (1, 2):
        want = tree([r for r in rows if r[0] == p], WAYS[policy], policy == "windowed")
        assert sorted((l, pytest.approx(s, abs=2e-6)) for l, s in want) == sorted(got[p])


@pytest.mark.parametrize("scale", [0.3, 4.0])
def test_pseudo_count_by_tiles(spark, rows, scale):
    """Where scores below one bring clusters closer, and where they don't: merges and their order."""
    own = [tuple(r) for r in spark.createDataFrame([(p, i, [x * scale for x in v]) for p, i, v in rows], ITEMS).collect()]
    got = found(cl.cluster_vectors(spark.createDataFrame(own, ITEMS), "geomean", 6, pseudo_count=1, side=4))
    for p in (1, 2):
        want = tree([r for r in own if r[0] == p], lambda v: 10 ** (sum(map(math.log10, v)) / (len(v) + 1)))
        assert [(l, pytest.approx(s, abs=2e-6)) for l, s in want] == got[p]


def test_rounding_as_spark_does(spark):
    values = [1.0000005, 1.0000015, 2.5, 0.1234565, 7.0000004999, 123.4567895, 0.0]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", 6)).collect()]
    assert blocks.rounded(blocks.np.array(values), 6).tolist() == want


def test_rounding_just_below_a_half():
    """Digits that end in a half go up even where the product with a power of ten comes out a little lower."""
    assert blocks.rounded(blocks.np.array([1.005, 8.345, 2.675]), 2).tolist() == [1.01, 8.35, 2.68]


@pytest.mark.parametrize("policy", [*WAYS, "pseudo"])
def test_no_round_writes_links(spark, rows, policy, monkeypatch):
    """Tiles are made anew from the vectors: a table kept between rounds has a row an item or a merge at most, and no column of links."""
    seen, keep = [], blocks.kept
    monkeypatch.setattr(blocks, "kept", lambda df, *a, **k: seen.append(df.dtypes) or keep(df, *a, **k))
    more = {"pseudo_count": 1} if policy == "pseudo" else {}
    cl.cluster_vectors(spark.createDataFrame(rows, ITEMS), "geomean" if more else policy, 6, side=4, **more)
    assert seen and not [x for x in seen if "binary" in dict(x).values()]


@pytest.fixture(scope="module")
def lines():
    """Suppliers' kind of items: one number each, with distances that are equal."""
    rng = random.Random(4)
    return [(p, i, [round(rng.uniform(0, 30), 1)]) for p in (1, 2) for i in range(1, 31 - 9 * p)]


def flat(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def no_pairs(monkeypatch):
    monkeypatch.setattr(cl, "all_pairs", lambda *a: pytest.fail("a table of all pairs"))


def test_single_linkage_by_tiles(spark, lines, monkeypatch):
    items = spark.createDataFrame(lines, "project int, id long, embedding array<double>")
    want = flat(cl.single(cl.distances(items, 2)))
    no_pairs(monkeypatch)
    assert flat(cl.cluster_vectors(items, "single", 2, side=4)) == want


@pytest.mark.parametrize("most", [None, 2])
def test_ladder_by_tiles(spark, lines, most, monkeypatch):
    items = spark.createDataFrame(lines, "project int, id long, embedding array<double>")
    score = (lambda s: s * 2, lambda c: c * 2)
    want = flat(cl.cluster_ladder(cl.distances(items, 2).withColumn("score", score[1](F.col("score"))), (1.0, 5.0, 30.0), most))
    no_pairs(monkeypatch)
    assert flat(cl.ladder_vectors(items, (1.0, 5.0, 30.0), most, 2, score, side=4)) == want


def test_flavours_by_tiles(spark, lines, monkeypatch):
    items = spark.createDataFrame(lines, "project int, id long, embedding array<double>").where("project = 2 OR id < 9")
    rank = F.rank().over(cl.Window.partitionBy("project").orderBy("score")).cast("double")
    want = flat(cl.flavours(cl.kept(cl.distances(items, 2)).withColumn("rank", rank), ("single", "complete"), ("simple", "tree"), difference=F.col("score"), rank=F.col("rank")))
    no_pairs(monkeypatch)
    assert flat(cl.vector_flavours(items, ("single", "complete"), ("simple", "tree"), 2)) == want


def test_own_linkage_by_tiles(spark, rows, monkeypatch):
    no_pairs(monkeypatch)
    own = (blocks.Linkage(lambda s: s * s, lambda t, n: blocks.np.sqrt(t / n)), None)
    got = found(cl.cluster_vectors(spark.createDataFrame(rows, ITEMS), places=6, side=4, own=own))
    for p in (1, 2):
        want = tree([r for r in rows if r[0] == p], lambda v: math.sqrt(MEAN([x * x for x in v])))
        assert sorted((l, pytest.approx(s, abs=2e-6)) for l, s in want) == sorted(got[p])


def test_no_items(spark):
    assert cl.cluster_vectors(spark.createDataFrame([], ITEMS), "complete").count() == 0
