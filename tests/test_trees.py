"""Trees by pointer doubling, forests, interval joins and tiles, against plain loops; chains take as many rounds as their length has bits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dendrospark.operators import cluster as cl
from dendrospark.operators import forest as fo
from dendrospark.operators import hierarchy as h
from dendrospark.operators import intervals as iv
from dendrospark.operators import relational as rel
from dendrospark.operators import storage
from dendrospark.operators import windows as wn
from dendrospark.operators.jumps import Tree, chain_ends, doubled
from dendrospark.operators.storage import kept

MERGES = "project string, step long, child_a string, child_b string, parent string, score double"
SCORES = "project string, id1 long, id2 long, score double"

# fixed values: a stored tree of 44 merges (children, parent), and the heights, least heights and depths of its merges
GOLDEN = """339 368 574;30 31 575;8 33 576;172 174 577;394 398 578;299 316 579;81 573 580;399 402 581;24 25 582;520 521 583;400 401 584;
338 m579 585;m578 m581 586;44 m582 587;452 m584 588;393 m588 589;26 m575 590;223 m577 591;451 m586 592;337 m574 593;396 397 594;496 m583 595;
185 m591 596;453 m594 597;m589 m592 598;m580 m596 599;m597 m598 600;m587 m599 601;454 m600 602;9 522 603;369 m602 604;553 m585 605;77 m601 606;302 m606 607;
m576 m607 608;m605 m608 609;m593 m603 610;305 m590 611;559 m595 612;m609 m611 613;m610 m612 614;m613 m614 615;m604 m615 616;560 m616 617"""
HEIGHTS = "1 1 1 1 1 1 1 1 1 1 1 2 2 2 2 3 2 2 3 2 1 2 3 2 4 4 5 5 6 1 7 3 6 7 8 9 3 3 3 10 4 11 12 13"
MIN_HEIGHTS = "1 1 1 1 1 1 1 1 1 1 1 1 2 1 1 1 1 1 1 1 1 1 1 1 2 2 2 2 1 1 1 1 1 1 2 2 2 1 1 2 2 3 2 1"
DEPTHS = "6 6 6 12 8 7 10 8 10 6 8 6 7 9 7 6 5 11 6 5 6 5 10 5 5 9 4 8 3 5 2 5 7 6 5 4 4 4 4 3 3 2 1 0"
#: Pairs with their scores; each line is what one bundle takes.
BUNDLES = """30 31 1.5E-67;8 33 1.4E-65;172 174 1.5E-64;398 402 1.8E-63;316 338 2.3E-63
394 399 3.8E-60;81 573 2.3E-57;520 521 4.3E-57;339 368 1.7E-55;393 452 2E-55;400 401 2.1E-54;25 44 5.4E-53
396 397 1.3E-49;185 223 9.4E-49
451 453 3.3E-38;9 522 1.8E-37
299 553 1.4E-25
369 454 5.6E-20;24 77 8.7E-16;302 305 4.2E-14"""


def golden(spark):
    rows = [x.split() for x in GOLDEN.replace("\n", "").split(";")]
    return spark.createDataFrame([("g", i, a, b, f"m{p}", 1.0) for i, (a, b, p) in enumerate(rows)], MERGES)


def chain(spark, n):
    """Each merge adds a leaf to the one before."""
    return spark.createDataFrame([("c", i, f"n{i - 1}" if i else "x", f"l{i}", f"n{i}", float(i)) for i in range(n)], MERGES)


def random_tree(rng, project, leaves):
    live, out = [f"{project}{i}" for i in range(leaves)], []
    for step in range(leaves - rng.randint(1, 3)):
        a, b = rng.sample(live, 2)
        live = [x for x in live if x not in (a, b)] + [f"{project}m{step}"]
        out.append((project, step, a, b, f"{project}m{step}", rng.choice([1e-95, 1e-50, 1e-12, 0.001, 3.0, 200.0])))
    return out


def test_golden_heights(spark):
    m = golden(spark)
    numbers = lambda t: list(map(int, t.split()))
    both = h.heights(m, height=F.max, low=F.min).join(h.depths(m), ["project", "node"]).join(m.select(F.col("parent").alias("node"), "step"), "node").orderBy("step").collect()
    assert [r.height for r in both] == numbers(HEIGHTS) and [r.low for r in both] == numbers(MIN_HEIGHTS) and [r.depth for r in both] == numbers(DEPTHS)


def test_golden_bundles(spark):
    bundles = [[("g", int(a), int(b), float(s)) for a, b, s in (x.split() for x in line.split(";"))] for line in BUNDLES.split("\n")]
    left = [r for b in bundles for r in b]
    for want in bundles:
        got = [tuple(r) for r in cl.window_bundle(spark.createDataFrame(left, SCORES)).select("project", "id1", "id2", "score").collect()]
        assert sorted(got) == sorted(want)
        left = [r for r in left if r not in got]


def test_long_chains_take_few_rounds(spark):
    n = 1383  # the largest stored tree
    m = chain(spark, n)
    t = Tree(m)
    assert len(t.jumps) <= math.ceil(math.log2(n + 1))
    got = {r.node: r for r in t.labels.collect()}
    for i in (0, 1, 700, n - 1):
        r = got[f"n{i}"]
        assert (r.depth, r.size, r.many, r.low, r.pre) == (n - 1 - i, 2 * i + 3, i + 2, 0, n - 1 - i)
    assert {r.node: r.height for r in h.heights(m).collect()}["n1382"] == n
    text = h.newick(m).first().text
    assert text == "(" * n + "x,l0" + "".join(f"),l{i}" for i in range(1, n)) + ")"
    scores = spark.createDataFrame([("c", i, i + 1, 1.0 + i) for i in range(n)], SCORES)
    tree, rounds = fo.spanning_forest(scores)
    assert rounds <= math.log2(n) and tree.count() == n
    merges = cl.cluster(scores, "single").orderBy("step").collect()
    assert [(r.step, r.child_a, r.child_b) for r in merges] == [(1, "0", "1")] + [(i + 1, str(i + 1), f"merge_node_{i}") for i in range(1, n)]


def kruskal(rows):
    out, root = [], {}
    for s, a, b in sorted((s, a, b) for _, a, b, s in rows if s is not None):
        while root.setdefault(a, a) != a:
            a = root[a]
        while root.setdefault(b, b) != b:
            b = root[b]
        if a != b:
            a, b = min(a, b), max(a, b)
            root[b] = a
            out.append((s, a, b))
    return out


@pytest.mark.parametrize("block", [3, fo.BLOCK])
def test_forest_is_one_merge_at_a_time(spark, block):
    rng = random.Random(4)
    rows = [("p", i, j, rng.choice([None, float(rng.randint(1, 9)), rng.random()])) for i in range(26) for j in range(i + 1, 26) if rng.random() < 0.2]
    rows += [("q", i, i + 1, rng.random()) for i in range(40)] + [("r", 0, i, float(i % 3)) for i in range(1, 12)] + [(None, 1, 2, 0.5)]
    tree, rounds = fo.spanning_forest(spark.createDataFrame(rows, SCORES).where("project IS NOT NULL"))
    assert rounds <= 6
    got = fo.forest_merges(tree, block).collect()
    for p in "pqr":
        assert [(r.score, r.id1, r.id2) for r in sorted(got, key=lambda r: r.step) if r.project == p] == kruskal([r for r in rows if r[0] == p])


def test_random_trees(spark):
    rng = random.Random(11)
    rows = [r for p in ("s", "t", "u") for r in random_tree(rng, p, rng.randint(8, 30))]
    m = kept(spark.createDataFrame(rows, MERGES))
    parent = {(p, c): q for p, _, a, b, q, _ in rows for c in (a, b)}
    nodes = {(p, x) for p, _, a, b, q, _ in rows for x in (a, b, q)}
    inner = {(p, q) for p, _, _, _, q, _ in rows}

    def up(p, x):
        while (p, x) in parent:
            x = parent[p, x]
            yield x

    pairs = {(p, x, a, k + 1) for p, x in nodes for k, a in enumerate(up(p, x))}
    assert {tuple(r) for r in h.node_ancestors(m).collect()} == pairs
    below = {(p, a, x, k) for p, x, a, k in pairs if (p, x) not in inner} | {(p, x, x, 0) for p, x in nodes - inner}
    got = [tuple(r) for r in h.leaves(m).collect()]
    assert set(got) == below and len(got) == len(below)
    values = spark.createDataFrame([(p, x, len(x)) for p, x in sorted(nodes)], "project string, node string, v long")
    want = {(p, x): len(x) + sum(len(c) for q, c, a, _ in pairs if (q, a) == (p, x)) for p, x in nodes}
    assert {(r.project, r.node): r.v for r in h.propagated(m, values, v=F.sum).collect()} == want

    steps = {p: [r for r in rows if r[0] == p] for p in "stu"}
    ladder = set()
    for p, own in steps.items():
        for t in h.THRESHOLDS:
            keep = set()
            for r in own:
                if r[5] > t:
                    break
                keep.add(r[4])
            for x in (x for q, x in nodes - inner if q == p):
                tops = [a for a in up(p, x) if a in keep]
                ladder.add((t, p, tops[-1] if tops else x, x))
    got = [(r.threshold, r.project, r.cluster, r.leaf) for r in h.cut_ladder(m).collect()]
    assert set(got) == ladder and len(got) == len(ladder)
    cut = [(r.project, r.cluster, r.leaf) for r in h.cut_tree(m, 1e-05).collect()]
    assert sorted(cut) == sorted(x[1:] for x in ladder if x[0] == 1e-05)

    omit = {n for n in sorted(nodes) if rng.random() < 0.2}
    gone = {(p, x) for p, x in nodes if (p, x) in omit or any((p, a) in omit for a in up(p, x))}
    live = {(p, a) for p, a, x, _ in below if (p, x) not in gone}
    kids = {(p, q): (a, b) for p, _, a, b, q, _ in rows}

    def end(p, x):
        while (p, x) in kids and sum((p, c) in live for c in kids[p, x]) == 1:
            x = next(c for c in kids[p, x] if (p, c) in live)
        return x

    want = {(p, s, end(p, a), end(p, b), q, x) for p, s, a, b, q, x in rows if (p, a) in live and (p, b) in live}
    marked = spark.createDataFrame(sorted(omit), "project string, node string")
    assert {tuple(r) for r in h.filter_tree(m, marked).collect()} == want
    nested = {(p, x) for p, x in omit if any((p, a) in omit for a in up(p, x))}
    assert {tuple(r) for r in h.without_nested(m, marked).collect()} == omit - nested


def test_bad_trees_are_errors(spark):
    for rows in ([("t", 0, "a", "b", "x", 1.0), ("t", 1, "a", "c", "y", 1.0)], [("t", 0, "y", "b", "x", 1.0), ("t", 1, "x", "c", "y", 1.0)]):
        with pytest.raises(ValueError):
            _ = Tree(spark.createDataFrame(rows, MERGES)).labels
    with pytest.raises(ValueError):
        doubled(spark.createDataFrame([(1, 2), (2, 1)], "id long, up long"), 2)
    with pytest.raises(ValueError):
        chain_ends(spark.createDataFrame([(1, 2), (2, 1)], "node long, to long"))
    empty = spark.createDataFrame([], MERGES)
    assert h.leaves(empty).count() == h.newick(empty).count() == h.cut_ladder(empty).count() == h.depths(empty).count() == 0


def test_closure_of_any_graph(spark):
    rng = random.Random(3)
    edges = sorted({(i, rng.randint(i + 1, 24)) for i in range(24) for _ in range(2)} | {(i, i + 1) for i in range(23)})
    ways = {}
    for i in reversed(range(24)):
        for a, b in edges:
            if a == i:
                for t, (lo, hi) in [(b, (0, 0)), *[(t, w) for (s, t), w in ways.items() if s == b]]:
                    old = ways.get((i, t), (99, 0))
                    ways[i, t] = (min(old[0], lo + 1), max(old[1], hi + 1))
    got = h.closure(spark.createDataFrame(edges, "child long, parent long"))
    assert {(r.child, r.ancestor): (r.least, r.most) for r in got.collect()} == ways
    with pytest.raises(ValueError):
        h.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long"))


def test_intervals(spark):
    rng = random.Random(6)
    points = [(g, rng.randint(0, m), m) for g, m in (("a", 37), ("b", 64), ("c", 1)) for _ in range(25)]
    spans = [(g, k, lo, lo + rng.randint(-2, 40), m) for k, (g, m) in enumerate([("a", 37), ("b", 64), ("c", 1)] * 12) for lo in [rng.randint(0, m)]]
    spans = [(g, k, lo, min(hi, m + 1), m) for g, k, lo, hi, m in spans]
    p = spark.createDataFrame([(g, i, x, m) for i, (g, x, m) in enumerate(points)], "g string, i int, x long, most long")
    s = spark.createDataFrame(spans, "g string, k int, lo long, hi long, most long")
    want = sorted((i, k) for i, (g, x, _) in enumerate(points) for h_, k, lo, hi, _ in spans if g == h_ and lo <= x < hi)
    assert sorted((r.i, r.k) for r in iv.containing(p, "x", s, "lo", "hi", ["g"]).collect()) == want
    many = {r.i: r.n for r in iv.depth_at(p, "x", s, "lo", "hi", ["g"]).collect()}
    assert many == {i: sum(w[0] == i for w in want) for i in range(len(points))}


def test_tiles_hold_all_pairs_and_no_more(spark):
    items = [("big", i) for i in range(40)] + [("small", i) for i in range(3)] + [("one", 1), ("big", 7)]
    df = spark.createDataFrame(items, "project string, id long")
    for tile, with_self in ((4, False), (4, True), (4096, True)):
        got = sorted((r.project, r.id1, r.id2) for r in rel.all_pairs(df, "id", with_self=with_self, tile=tile).collect())
        assert got == sorted((p, a, b) for p, a in items for q, b in items if p == q and (a <= b if with_self else a < b))
    strips = rel.tiled(df.select("project", F.col("id").alias("x")), df.select("project", F.col("id").alias("y")), ("x", "y"), 4)
    plan = strips._jdf.queryExecution().optimizedPlan().toString()
    assert "_li" in plan and strips.where("project = 'big'").count() == 41 * 41


def test_numbers_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, i int")
    got = wn.numbered(df, ["g"], [F.desc("k"), F.col("i")], "n").collect()
    want = {}
    for g in {r[0] for r in rows}:
        want |= {i: n + 1 for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])))}
    assert {r.i: r.n for r in got} == want and len(got) == len(rows)
    assert sorted(r.i for r in rel.first_rows(df.withColumnRenamed("g", "project"), 2, F.desc("k"), F.col("i")).collect()) == sorted(i for i, n in want.items() if n <= 2)


def test_pairs_of_a_project_are_dealt_to_tasks_by_their_number(spark):
    items = spark.range(3000).select(F.lit(1).alias("project"), "id")
    rows = rel.all_pairs(items, "id").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in rows) == 3000 * 2999 // 2
    assert len(rows) > 4 and max(r["count"] for r in rows) < 2_250_000


def test_tables_of_many_rows_are_not_broadcast_in_tree_joins(spark):
    few, many = (storage.shuffled(spark.range(n).select("id", (F.col("id") * 3).alias("x"))) for n in (10, storage.FEW + 1))
    joined = lambda t: t.join(t.select("id", F.col("x").alias("y")), "id").where("x = y").select("id")
    assert "BroadcastExchange" in joined(few)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in joined(many)._jdf.queryExecution().executedPlan().toString()
    assert joined(many).count() == storage.FEW + 1


def test_first_rows_and_large_samples_load_no_single_task(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("project"), F.col("id").alias("id1"), (F.col("id") * 7 % 60_000).alias("id2"))
    plan = rel.first_rows(df, 2, F.col("id2"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    order = F.xxhash64("id1", "id2")
    for rows in (25_000, 60_000):
        got = rel.sample_pairs(df, rows, order, one_task=1000)
        assert "TakeOrderedAndProject" not in got._jdf.queryExecution().executedPlan().toString()
        want = df.orderBy(order, *df.columns).limit(rows)
        assert got.count() == rows and got.exceptAll(want).isEmpty()


def test_tasks_thin_their_links_and_keep_the_forest(spark):
    rng = random.Random(7)
    rows = [(p, a, b, float(rng.randint(0, 20))) for p in ("p", "q") for a in range(40) for b in range(a + 1, 40)]
    want = []
    for p in ("p", "q"):
        root = list(range(40))
        for _, x, y, s in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[1], r[2])):
            if root[x] != root[y]:
                want.append((p, x, y, s))
                root = [root[x] if r == root[y] else r for r in root]
    df = spark.createDataFrame(rows, "project string, id1 long, id2 long, score double").repartition(2)
    for part in (100, 10_000):
        thin = fo.thinned(df, part).collect()
        assert set(want) <= set(map(tuple, thin)) and len(thin) < len(rows) / 2
    assert sorted(map(tuple, fo.spanning_forest(df)[0].collect())) == sorted(want)
