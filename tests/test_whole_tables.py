"""Queries over all customers and all parts, against brute force on the smallest tables."""

from pathlib import Path

import pytest

from dendrospark import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def rows(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(*columns).collect()]


@pytest.fixture(scope="module")
def world(spark):
    region = dict(rows(spark, "region", "r_regionkey", "r_name"))
    nation = {k: (n, region[r]) for k, n, r in rows(spark, "nation", "n_nationkey", "n_name", "n_regionkey")}
    up = {n: {r, "all"} for n, r in nation.values()} | {r: {"all"} for r in region.values()}
    sets = {}
    for k, segment, n in rows(spark, "customer", "c_custkey", "c_mktsegment", "c_nationkey"):
        sets.setdefault(f"{segment}{k % 40}", set()).add(nation[n][0])
    return sets, up, set(region.values())


def same(spark, name, want):
    got = queries.QUERIES[name](spark, str(DATA)).select("key", *[c for c in ("term", "ancestor", "n") if c in queries.QUERIES[name](spark, str(DATA)).columns])
    assert want and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_common_ancestors(spark, world):
    sets, up, tops = world
    common = {k: set.intersection(*[up[t] for t in s]) for k, s in sets.items()}
    same(spark, "GR-04_common_ancestors", [(k, a) for k, c in common.items() for a in c])
    best = [(k, min(s) if len(s) == 1 else min(a for a in common[k] if not any(a in up.get(o, ()) for o in common[k]))) for k, s in sets.items()]
    same(spark, "GR-05_most_specific_common_ancestor", best)
    line = [(k, a) for k, c in common.items() if len(c) > 1 for a in c]
    few = [k for k, c in common.items() if len(c) < 2]
    same(spark, "GR-11_common_lineage", line + [(k, "everything") for k in few] + [(k, a) for k in few for a in set().union(*[up[t] for t in sets[k]]) & tops])


def test_most_specific_and_general(spark, world):
    sets, up, _ = world
    mixed = {k: s | (set().union(*[up[t] for t in s]) - {"all"} if k.endswith("1") else set()) for k, s in sets.items()}
    low = [(k, t) for k, s in mixed.items() for t in s if not any(t in up.get(o, ()) for o in s)]
    same(spark, "GR-06_most_specific", low)
    same(spark, "GR-06_most_general", [(k, t) for k, s in mixed.items() for t in s if not up.get(t, set()) & s])
    same(spark, "GR-09_annotation_specific", [(k, sum(x == k for x, _ in low)) for k in mixed])


def test_later_scans(spark):
    trees = {}
    for (k,) in rows(spark, "part", "p_partkey"):
        trees.setdefault((k - 1) // 64, []).append((k - 1) % 64 + 1)
    want = []
    for tree, nodes in trees.items():
        n = max(nodes)
        merges = sorted((n - k, k) for k in nodes if 2 * k + 1 <= n)  # step, parent
        alive = {c for _, k in merges for c in (2 * k, 2 * k + 1)} - {k for _, k in merges}
        for step, k in merges:
            alive -= {2 * k, 2 * k + 1}
            want += [(str(tree), step, str(x)) for x in alive]
            alive.add(k)
    got = queries.QUERIES["JN-12_later_scans"](spark, str(DATA))
    assert len(trees) > 1 and sum(map(len, trees.values())) == len(rows(spark, "part", "p_partkey"))
    assert want and sorted(map(tuple, got.select("project", "step", "other").collect())) == sorted(want)
