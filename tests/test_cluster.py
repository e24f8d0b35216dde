"""Trees by rounds against one merge at a time; matchings against a sequential scan; tree algebra."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dendrospark.operators import aggregates as ag
from dendrospark.operators import cluster as cl
from dendrospark.operators import hierarchy as h
from dendrospark.operators import quality
from dendrospark.sources import trees

SCORES = "project string, id1 long, id2 long, score double"
N = 7


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(f"p{p}", i, j, rng.random()) for p in range(2) for i in range(N) for j in range(i + 1, N)]


def one_at_a_time(rows, project, policy):
    s = {(a, b): x for p, a, b, x in rows if p == project}
    of = {"single": min, "complete": max, "rescored": lambda v: sum(v) / len(v), "geomean": lambda v: 10 ** (sum(map(math.log10, v)) / len(v))}[policy]
    members, out = {i: [i] for i in range(N)}, []
    while len(members) > 1:
        x, a, b = min((of([s[min(i, j), max(i, j)] for i in members[a] for j in members[b]]), a, b) for a in members for b in members if a < b)
        out.append((tuple(sorted(members[a] + members[b])), round(x, 9)))
        members[a] += members.pop(b)
    return sorted(out)


@pytest.mark.parametrize("policy", ["single", "complete", "rescored", "geomean"])
def test_policies(spark, rows, policy):
    merges = cl.kept(cl.cluster(spark.createDataFrame(rows, SCORES), policy))
    below = {(r.project, r.node): tuple(sorted(map(int, r.l))) for r in h.leaves(merges).groupBy("project", "node").agg(F.collect_set("leaf").alias("l")).collect()}
    for p in ("p0", "p1"):
        assert sorted((below[p, r.parent], round(r.score, 9)) for r in merges.where(F.col("project") == p).collect()) == one_at_a_time(rows, p, policy)


def test_greedy_matching_is_a_sequential_scan(spark):
    rng = random.Random(9)
    rows = [("p", i, j, float(rng.randint(1, 4))) for i in range(10) for j in range(i + 1, 10) if rng.random() < 0.6]
    used, want = set(), []
    for _, i, j, s in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if not {i, j} & used:
            used |= {i, j}
            want.append((i, j, s))
    got = cl.greedy_matching(spark.createDataFrame(rows, SCORES)).collect()
    assert sorted((r.id1, r.id2, r.score) for r in got) == sorted(want)


def test_nearest_and_merge(spark):
    rows = [("p", 1, 2, 5.0), ("p", 1, 3, 5.0), ("p", 1, 4, 1.0), ("p", 2, 3, 7.0), ("p", 2, 4, 2.0), ("p", 3, 4, 3.0)]
    scores = spark.createDataFrame(rows, SCORES)
    assert sorted((r.id, r.partner, r.score) for r in ag.nearest(scores).collect()) == [(1, 4, 1.0), (2, 4, 2.0), (3, 4, 3.0), (4, 1, 1.0)]
    pair = spark.createDataFrame([("p", 2, 4, 99)], "project string, id1 long, id2 long, parent long")
    after = cl.merge_pairs(scores, pair, lambda a, b: F.lit(123.0))
    assert sorted((r.id, r.partner, r.score) for r in ag.nearest(after).collect()) == [(1, 3, 5.0), (3, 1, 5.0), (99, 1, 123.0)]
    assert cl.merge_pairs(scores, pair).count() == 1
    lone = spark.createDataFrame([("q", 1), ("q", 2)], "project string, id long")
    assert {(r.partner, r.score) for r in ag.nearest(scores.limit(0), lone).collect()} == {(None, float("inf"))}


def test_traces_and_folds(spark, tmp_path):
    merges = spark.createDataFrame([("t", 1, "1", "2", "x", 2.3), ("t", 2, "x", "3", "y", 5.6), ("u", 1, "merge_node_4", "a", "z", None)], "project string, step long, child_a string, child_b string, parent string, score double")
    rows = {(r.project, r.step): (r.child_a, r.child_b, r.parent, r.score) for r in trees.trace_rows(merges).collect()}
    assert rows["t", 1] == ("1", "2", "merge_node_1", 2.3) and rows["t", 2] == ("merge_node_1", "3", "merge_node_2", 5.6)
    assert rows["u", 1] == ("merge_node_4", "a", "merge_node_5", 100_000_000.0)
    assert {r.text for r in h.newick(merges).collect()} == {"((1,2),3)", "(merge_node_4,a)"}
    path = str(tmp_path / "t.trace")
    open(path, "w").write("1\t2\tm1\t1e-5\nm1\t3\tm2\t2e-3\n")
    assert [(r.step, r.child_a, r.parent, r.score) for r in trees.read_traces(spark, path).orderBy("step").collect()] == [(1, "1", "m1", 1e-5), (2, "m1", "m2", 2e-3)]
    assert merges.where("project = 't'").agg(ag.geometric_mean(F.col("score")).alias("x")).first().x == pytest.approx(3.58887168898527)


def test_filter_tree_and_closure(spark):
    merges = spark.createDataFrame([("t", 1, "a", "b", "x", 1.0), ("t", 2, "c", "d", "y", 2.0), ("t", 3, "x", "y", "z", 3.0)], "project string, step long, child_a string, child_b string, parent string, score double")
    omit = spark.createDataFrame([("t", "a"), ("t", "y")], "project string, node string")
    assert h.filter_tree(merges, omit).count() == 0
    got = h.filter_tree(merges, omit.where("node = 'a'")).collect()
    assert sorted((r.child_a, r.child_b, r.parent) for r in got) == [("b", "y", "z"), ("c", "d", "y")]
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "child long, parent long")
    up = h.closure(edges)
    assert {(r.child, r.ancestor, r.least, r.most) for r in up.collect()} == {(1, 2, 1, 1), (1, 3, 1, 2), (1, 4, 2, 3), (2, 3, 1, 1), (2, 4, 2, 2), (3, 4, 1, 1)}
    assert h.closure(edges.limit(0)).count() == 0


def test_same_partition_has_no_distance(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "cluster string, item long")
    assert quality.variation_of_information(a, a.withColumnRenamed("cluster", "class")).first().vi == pytest.approx(0)
    assert quality.purity(a, a.withColumnRenamed("cluster", "class")).first().purity == 1


@pytest.mark.parametrize("few", [50_000, 0])
def test_merged_scores_are_not_all_shuffled(spark, monkeypatch, few):
    """Few pairs go to every task: the scores of other items meet them without a shuffle. Many pairs give the same rows."""
    monkeypatch.setattr(cl, "FEW", few)
    rng = random.Random(3)
    rows = [(p, i, j, float(rng.randint(1, 90))) for p in ("p", "q", "r") for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.8]
    merged = {("p", 1): 91, ("p", 5): 91, ("p", 2): 92, ("p", 9): 92, ("q", 0): 93, ("q", 13): 93}
    pairs = spark.createDataFrame([("p", 1, 5, 91), ("p", 2, 9, 92), ("q", 0, 13, 93)], "project string, id1 long, id2 long, parent long")
    scores = spark.createDataFrame(rows, SCORES)
    want, sides = [r for r in rows if (r[0], r[1]) not in merged and (r[0], r[2]) not in merged], {}
    for p, i, j, s in rows:
        for a, b in ((i, j), (j, i)):
            if (p, a) in merged and (p, b) not in merged:
                sides.setdefault((p, b, merged[p, a]), []).append(s)
    apart = cl.merge_pairs(scores, pairs)
    assert sorted(map(tuple, apart.collect())) == sorted(want)
    assert ("SortMergeJoin" in apart._jdf.queryExecution().sparkPlan().toString()) == (few == 0)
    got = cl.merge_pairs(scores, pairs, F.greatest)
    assert sorted(map(tuple, got.collect())) == sorted(want + [(*k, max(v)) for k, v in sides.items()])
