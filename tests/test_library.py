"""Trees with gaps and ties, ladders, hooks, text sinks and readers against plain loops and fixed cases."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from dendrospark.operators import aggregates as ag
from dendrospark.operators import cluster as cl
from dendrospark.operators import hierarchy as h
from dendrospark.operators import relational as rel
from dendrospark.operators import windows as wn
from dendrospark.sources import text as src
from dendrospark.sources import trees

SCORES = "project string, id1 long, id2 long, score double"
RNG = random.Random(12)
MEAN = lambda v: sum(v) / len(v)


def scored(n=8, gaps=0.0, values=None):
    pick = lambda: RNG.choice(values) if values else round(RNG.random() * 10 + 0.01, 6)
    return [("p", i, j, pick()) for i in range(n) for j in range(i + 1, n) if RNG.random() >= gaps]


def score_of(policy, own, pairs, extra=0):
    """Of the scored member pairs, out of ``pairs``."""
    if policy == "complete":
        return max(own) if len(own) == pairs else math.inf
    if policy == "geomean":
        return 10 ** ((sum(math.log10(x or 1e-200) for x in own) + 10 * (pairs - len(own))) / (pairs + extra))
    return {"single": min, "rescored": MEAN, "rms": lambda v: math.sqrt(MEAN([x * x for x in v]))}[policy](own)


def tree(rows, policy, extra=0, bundle=False):
    """Leaves and score of each merge, one merge (or, for ``bundle``, one window's matching) at a time."""
    s = {(a, b): x for _, a, b, x in rows}
    members, out = {i: [i] for i in sorted({i for k in s for i in k})}, []
    while True:
        links = []
        for a in members:
            for b in members:
                if a < b and (own := [s[min(i, j), max(i, j)] for i in members[a] for j in members[b] if (min(i, j), max(i, j)) in s]):
                    links.append((score_of(policy, own, len(members[a]) * len(members[b]), extra), a, b))
        if not links:
            return sorted(out)
        links.sort()
        top = 10.0 ** (10 * math.ceil(math.log10(links[0][0]) / 10)) if bundle else 0
        used = set()
        for x, a, b in [k for k in links if k[0] <= top] if bundle else links[:1]:
            if not used & {a, b}:
                used |= {a, b}
                out.append((tuple(sorted(members[a] + members[b])), round(x, 9)))
                members[a] = members[a] + members.pop(b)


def found(merges):
    merges = cl.kept(merges)
    below = {r.node: tuple(sorted(map(int, r.l))) for r in h.leaves(merges).groupBy("node").agg(F.collect_set("leaf").alias("l")).collect()}
    return sorted((below[r.parent], round(r.score, 9)) for r in merges.collect())


@pytest.mark.parametrize("policy", ["single", "complete", "geomean"])
def test_trees_with_gaps(spark, policy):
    rows = scored(8, 0.35)
    assert found(cl.cluster(spark.createDataFrame(rows, SCORES), policy)) == tree(rows, policy)


def test_ties_give_the_same_clusters_at_each_score(spark):
    rows = scored(9, 0.6, [1.0, 2.0, 3.0])
    merges = cl.kept(cl.cluster(spark.createDataFrame(rows, SCORES), "single"))
    for top in (1.0, 2.0, 3.0):
        got = {}
        for r in h.cut_tree(merges, top).collect():
            got.setdefault(r.cluster, set()).add(int(r.leaf))
        root = {i: i for _, a, b, _ in rows for i in (a, b)}
        for _ in root:
            for _, a, b, x in rows:
                if x <= top:
                    root[a] = root[b] = min(root[a], root[b])
        want = {}
        for i, r in root.items():
            want.setdefault(r, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_unscored_pair_stands_at_infinity(spark):
    rows = [("p", 1, 2, 1.0), ("p", 2, 3, 2.0)]
    assert found(cl.cluster(spark.createDataFrame(rows, SCORES), "complete")) == [((1, 2), 1.0), ((1, 2, 3), math.inf)]


def test_pseudo_count_and_windows_and_hook(spark):
    rows = scored(7)
    data = spark.createDataFrame(rows, SCORES)
    assert found(cl.cluster(data, "geomean", pseudo_count=1)) == tree(rows, "geomean", extra=1)
    assert found(cl.cluster(data, "geomean", pseudo_count=1, items=3)) == tree(rows, "geomean", extra=1)  # a round a merge
    for n, gaps, values in ((30, 0.0, None), (25, 0.5, None), (14, 0.3, (1e-3, 1e-9, 0.0, 2.0))):  # with scores below one, a merge can bring clusters closer
        more = [(p, a, b, x / 50 if values is None else x) for p, a, b, x in scored(n, gaps, values)]
        assert found(cl.cluster(spark.createDataFrame(more, SCORES), "geomean", pseudo_count=1)) == tree(more, "geomean", extra=1)
    assert found(cl.cluster(data, "windowed")) == tree(rows, "rescored", bundle=True)
    own = ({"t": F.col("score") * F.col("score"), "n": F.lit(1).cast("long")}, {"t": F.sum("t"), "n": F.sum("n")}, F.sqrt(F.col("t") / F.col("n")))
    assert found(cl.cluster(data, linkage=own)) == tree(rows, "rms")


def test_long_chain_has_no_limit_of_rounds(spark):
    rows = [("p", i, i + 1, float(i + 1)) for i in range(12)]
    assert len(found(cl.cluster(spark.createDataFrame(rows, SCORES), "single"))) == 12


def test_ladder(spark):
    rows, steps = scored(8), (1.0, 4.0, 20.0)
    s, members, want = {(a, b): x for _, a, b, x in rows}, {i: [i] for i in range(8)}, []
    for top in steps:
        while True:
            links = sorted((MEAN([s[min(i, j), max(i, j)] for i in members[a] for j in members[b]]), a, b) for a in members for b in members if a < b)
            used = set()
            for x, a, b in links:
                if x <= top and not used & {a, b}:
                    used |= {a, b}
                    want.append((tuple(sorted(members[a] + members[b])), round(x, 9)))
                    members[a] = members[a] + members.pop(b)
            if not used:
                break
    assert found(cl.cluster_ladder(spark.createDataFrame(rows, SCORES), steps)) == sorted(want)
    assert len(h.THRESHOLDS) == 12


def test_window_bundle(spark):
    rows = [("p", 1, 2, 3e-21), ("p", 3, 4, 2e-20), ("p", 2, 3, 1e-20), ("p", 5, 6, 9e-12), ("p", 7, 8, 2e-10)]
    got = cl.window_bundle(spark.createDataFrame(rows, SCORES)).collect()
    assert sorted((r.id1, r.id2) for r in got) == [(1, 2)]  # up to 1e-20; 2 is taken
    rows[0] = ("p", 1, 2, 3e-19)
    got = cl.window_bundle(spark.createDataFrame(rows[:1] + rows[3:], SCORES)).collect()
    assert sorted((r.id1, r.id2) for r in got) == [(1, 2), (5, 6)]  # up to 1e-10


def test_flavours(spark):
    rows = scored(6)
    data = spark.createDataFrame(rows, SCORES)
    got = cl.kept(cl.flavours(data, ("single", "complete"), plain=F.col("score"), square=F.col("score") * F.col("score")))
    for kind, of in (("plain", lambda x: x), ("square", lambda x: x * x)):
        for policy in ("single", "complete"):
            assert found(got.where(F.col("kind") == kind).where(F.col("policy") == policy).drop("kind", "policy")) == tree([(p, a, b, of(x)) for p, a, b, x in rows], policy)


MERGES = "project string, step long, child_a string, child_b string, parent string, score double"


def test_text_sinks(spark):
    rows = [("p", 1, 'a"1', "b", "n1", 1e-90), ("p", 2, "n1", "c", "n2", 1e-10), ("q", 1, "x", "y", "z", -1.0)]
    merges = spark.createDataFrame(rows, MERGES)
    lengths = {r.parent: r.branch_length for r in h.branch_lengths(merges).collect()}
    text = {r.project: json.loads(r.text) for r in h.json_tree(merges).collect()}
    assert text["p"]["id"] == text["p"]["name"] == "n2" and text["p"]["data"] == {"branch_length": lengths["n2"]}
    assert [c["id"] for c in text["p"]["children"]] == ["n1", "c"] and text["p"]["children"][0]["children"][0] == {"id": 'a"1', "name": 'a"1', "children": []}
    assert {r.project: r.text for r in h.newick(merges).collect()} == {"p": '((a"1,b),c)', "q": "(x,y)"}
    n = {k: str(v) for k, v in lengths.items()}
    assert {r.project: r.text for r in h.newick_lengths(merges).collect()}["p"] == f'((a"1:{n["n1"]},b:{n["n1"]})cn1:{n["n2"]},c:{n["n2"]})cn2'


def test_cycles_are_errors(spark):
    round_trip = spark.createDataFrame([("p", 1, "a", "b", "n1", 1.0), ("p", 2, "n3", "c", "n2", 1.0), ("p", 3, "n2", "d", "n3", 1.0)], MERGES)
    with pytest.raises(ValueError, match="cycle"):
        h.newick(round_trip)
    with pytest.raises(ValueError, match="cycle"):
        h.closure(h.tree_edges(round_trip), "project")


def test_heights_and_cuts(spark):
    rows = [("p", 1, "a", "b", "n1", 1e-95), ("p", 2, "n1", "c", "n2", 1e-15), ("p", 3, "n2", "d", "n3", 50.0)]
    merges = spark.createDataFrame(rows, MERGES)
    assert {r.node: r.height for r in h.heights(merges, F.min).where("node like 'n%'").collect()} == {"n1": 1, "n2": 1, "n3": 1}
    assert {r.node: r.height for r in h.heights(merges).where("node like 'n%'").collect()} == {"n1": 1, "n2": 2, "n3": 3}
    cuts = h.cut_ladder(merges).groupBy("threshold").agg(F.countDistinct("cluster").alias("n")).collect()
    assert {r.threshold: r.n for r in cuts} == {t: 4 if t < 1e-95 else 3 if t < 1e-15 else 2 if t < 50 else 1 for t in h.THRESHOLDS}


def test_merge_runs(spark):
    rows = [("x", 1, 10, "A"), ("x", 15, 30, "B"), ("x", 40, 50, "A"), ("x", 60, 70, "A"), ("x", 90, 99, "B"), ("y", 1, 9, "B"), ("y", 20, 30, "A")]
    got = wn.merge_runs(spark.createDataFrame(rows, "protein string, start int, stop int, family string"), ["A", "B"]).collect()
    plain = sorted((r.protein, r.family, [(s.start, s.stop) for s in r.segments]) for r in got)
    assert plain == [("x", "A", [(40, 50)]), ("x", "A-B", [(1, 30)]), ("x", "A-B", [(60, 70), (90, 99)]), ("y", "A", [(20, 30)]), ("y", "B", [(1, 9)])]


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path / name}"


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "f.faa", "\n>id1 desc with a>b\r\nAC GT\nAA\n>id2\nTT\n>id1\tlater\nGG\n>empty")
    got = src.read_fasta(spark, path, order=True)
    assert [tuple(r)[:4] for r in got.orderBy("at").collect()] == [("f", "id1", "desc with a>b", "ACGTAA"), ("f", "id2", "", "TT"), ("f", "id1", "later", "GG"), ("f", "empty", "", "")]
    assert {r.seq_id: r.sequence for r in src.last_records(got).collect()} == {"id1": "GG", "id2": "TT", "empty": ""}


def test_scores(spark, tmp_path):
    path = put(tmp_path, "a.scan", "x  y \t1e-3\n y\tz 2\n")
    scores = src.read_scores(spark, path)
    assert sorted(map(tuple, scores.collect())) == [("x", "y", 0.001), ("y", "z", 2.0)]
    pairs = spark.createDataFrame([("y", "x"), ("x", "z")], "id1 string, id2 string")
    assert [tuple(r) for r in src.missing_scores(pairs, scores).collect()] == [("x", "z")]
    for text in ("x y\n", "x y z\n", "x y 1 2\n"):
        with pytest.raises(Exception, match="not a score"):
            src.read_scores(spark, put(tmp_path, f"{len(text)}{text[-2]}.bad", text)).collect()
    with pytest.raises(ValueError):
        src.read_scores(spark, put(tmp_path, "none.scan", ""))
    with pytest.raises(Exception):
        src.read_scores(spark, f"file://{tmp_path}/missing")


def test_scores_of_a_job_with_empty_partitions(spark, tmp_path):
    rows = spark.range(8).where("id = 7").select(F.col("id").cast("string").alias("id1"), F.lit("y").alias("id2"), F.lit(0.5).alias("score"))
    src.write_scores(rows, f"file://{tmp_path}/job", sep=" ")
    (tmp_path / "job" / "part-empty.csv").write_text("")
    assert [tuple(r) for r in src.read_scores(spark, f"file://{tmp_path}/job").collect()] == [("7", "y", 0.5)]
    src.write_scores(rows.where("false"), f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        src.read_scores(spark, f"file://{tmp_path}/none")


def test_other_formats(spark, tmp_path):
    old = trees.read_old_traces(spark, put(tmp_path, "t.trace", "a 0.5 n1 x\nb 0.5 n1 x\nn1 2.0 n2 x\nc 2.0 n2 x\n"))
    assert sorted(map(tuple, old.collect())) == [("t", 1, "a", "b", "n1", 0.5), ("t", 2, "n1", "c", "n2", 2.0)]
    hits = src.read_hits(spark, put(tmp_path, "h.tsv", "#q\nq\tt\t98.5\t40\t1e-9\t77.1\n"), "blast")
    assert [tuple(r) for r in hits.collect()] == [("q", "t", 98.5, 40, 1e-9, 77.1)]
    terms = spark.createDataFrame([("t1", "one", "F"), ("t2", "two", "P")], "term string, name string, type string")
    src.write_term_names(terms, f"file://{tmp_path}/terms")
    assert [r.term for r in src.read_term_names(spark, f"file://{tmp_path}/terms", "^F$").collect()] == ["t1"]
    for mode in ("overwrite", "append"):
        src.write_clusters(terms, f"file://{tmp_path}/by", "type", mode)
    assert src.read_rows(spark, put(tmp_path, "r.tsv", "1\ta\n"), "k int, v string").first() == (1, "a") and spark.read.parquet(f"file://{tmp_path}/by").count() == 4
    with pytest.raises(Exception):
        src.write_clusters(terms, f"file://{tmp_path}/by", "type")


def test_small_operators(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5)], "k string, v int")
    assert tuple(ag.size_summary(ag.cluster_sizes(rows, "k"), "k").first()) == (5, 2, "a")
    got, missing = rel.first_matches(spark.createDataFrame([("a",), ("z",)], "id string"), rows, "id", "k", "v")
    assert [tuple(r) for r in got.collect()] == [("a", 1)] and [r.id for r in missing.collect()] == ["z"]
    assert [r.v for r in rel.row_limit(rows, 2, F.desc("v")).collect()] == [5, 4] and rel.shuffled(rows, "v", 1).count() == 5
    assert rel.union_all(rows, rows).count() == 10 and rel.pool_mappings(rows, rows).count() == 5
    assert sorted(map(tuple, ag.length_spread(rows, "k", F.col("v")).collect())) == [("a", 200.0), ("b", 100.0), ("c", 125.0)]
