"""Groups with most rows of a table are dealt to several tasks."""

import random

from pyspark.sql import functions as F

from dendrospark.operators import aggregates as ag

TERMS, CODES = "item long, term long", "item long, code string"


def transferred(spark, few, part):
    terms = spark.createDataFrame([(i, t) for i in range(60) for t in range(4) if t < 2 or i % (t + 1) == 0], TERMS)
    codes = spark.createDataFrame([(0, "a"), (6, "a"), (1, "b"), (8, "c")], CODES)
    return [sorted(map(tuple, x.collect())) for x in ag.annotation_transfer(terms, codes, terms.where("term <> 1").select("term").distinct(), few, part)]


def test_transfer_of_common_terms_dealt_to_parts(spark):
    assert transferred(spark, 0, 10) == transferred(spark, 1000, 10)
    more_terms, more_codes = transferred(spark, 0, 10)
    # a goes with terms 0, 2 and 3 (of items 0 and 6), b with 0 alone, c with 0 and 3
    assert {i for i, c in more_codes if c == "a"} == {i for i in range(60) if i % 12 == 0} | {0, 6}
    assert {i for i, c in more_codes if c == "b"} == set(range(60))
    assert {i for i, c in more_codes if c == "c"} == {i for i in range(60) if i % 4 == 0}
    assert (6, 3) in more_terms


def test_spread_join_gives_no_task_a_whole_key(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    own = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, name string")
    got = ag.spread_join(rows, own, "k", "x", few=0, part=500).withColumn("task", F.spark_partition_id())
    assert got.count() == 8000 and got.select("x", "name").distinct().count() == 8000
    by_plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in by_plan


def test_triples_without_pairs_of_pairs(spark):
    from dendrospark.operators.relational import score_triples

    rows = [(i % 2, i, j, float(i * 100 + j)) for i in range(24) for j in range(i + 2, 24, 2) if (i * j) % 5]
    rows += [(0, 2, 4, 7.5), (0, 6, 6, 1.0)]  # a second score of a pair; an item with itself
    want = []
    both = [(i, j, s) for _, i, j, s in rows if i != j] + [(j, i, s) for _, i, j, s in rows if i != j]
    for a, b, ab in both:
        for b2, c, bc in both:
            if b2 == b and c != a:
                want += [(a, b, c, ab, bc, ac) for a2, c2, ac in both if (a2, c2) == (a, c)]
    scores = spark.createDataFrame(rows, "project int, id1 long, id2 long, score double")
    got = score_triples(scores, side=5)
    assert got.columns == ["a", "b", "c", "ab", "bc", "ac"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[0]
    assert sorted(map(tuple, score_triples(scores.drop("project"), side=5).collect())) == sorted(want)


def test_triples_of_projects_with_odd_names(spark):
    """Tiles have short names that no project's name can confuse, and rows that hold what a tile needs only."""
    from dendrospark.operators.relational import score_triples

    rng = random.Random(4)
    rows = [(p, 100 * k + i, 100 * k + j, float(rng.randint(1, 9))) for k, p in enumerate(("1", "1/1", "0/1", "")) for i in range(12) for j in range(i) if rng.random() < 0.7]
    link = {(a, b): s for _, i, j, s in rows for a, b in ((i, j), (j, i))}
    want = sorted((a, b, c, s, link[b, c], link[a, c]) for (a, b), s in link.items() for c in range(a // 100 * 100, a // 100 * 100 + 12) if (b, c) in link and (a, c) in link)
    for side in (2, 5, 512):
        got = score_triples(spark.createDataFrame(rows, "project string, id1 long, id2 long, score double"), side)
        assert sorted(map(tuple, got.collect())) == want
    shuffled = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if " AS tile#" in x]
    assert len(shuffled) == 1 and shuffled[0].count("#") and " AS t0#" not in shuffled[0] and "to_json" not in shuffled[0]
