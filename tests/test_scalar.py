"""Values that the scalar functions must give."""

import pytest
from pyspark.sql import functions as F

from dendrospark.functions import scalar as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*x):
    return F.array(*[F.lit(i) for i in x]) if x else F.array().cast("array<string>")


def test_cluster_key(spark):
    assert one(spark, fn.cluster_key(strings("my_clust_1", "my_clust_2"))) == "n0de_4501c47c831144d7311bbdf6da7f5d84"
    assert one(spark, fn.cluster_key(strings("my_clust_1", "my_clust_2", "my_clust_3"))) == "n0de_b058f5b851e76e27506d4f7f1949d558"
    assert one(spark, fn.cluster_key(strings("a"))) == "a"
    with pytest.raises(Exception, match="member"):
        one(spark, fn.cluster_key(strings()))


def test_natural_order(spark):
    names = [f"clst_{i}" for i in (12, 10, 2, 99, 101, 102, 11, 100, 1)]
    assert one(spark, fn.natural_sorted(strings(*names))) == [f"clst_{i}" for i in (1, 2, 10, 11, 12, 99, 100, 101, 102)]
    assert one(spark, fn.natural_sorted(strings("b", "a1b2", "a10", "a9"))) == ["a9", "a10", "a1b2", "b"]


def test_combine_members(spark):
    a, b = strings("1", "3"), strings("2", "4")
    assert one(spark, fn.combine_members(a, b)) == ["1", "2", "3", "4"]
    assert one(spark, fn.combine_members(a, b, "tree")) == ["1", "3", "2", "4"]


def test_score_window(spark):
    assert one(spark, fn.score_window(F.lit(1.2e-15))) == 1e-10
    assert one(spark, fn.score_window(F.lit(1.2e-15), up=False)) == 1e-20
    for p in range(-90, 11, 10):
        x = float(f"1e{p}")
        assert one(spark, fn.score_window(F.lit(x), up=False)) <= x <= one(spark, fn.score_window(F.lit(x)))
    assert one(spark, fn.score_window(F.lit(0.0))) is None


def test_segments(spark):
    segs = fn.parse_segments(F.lit("60-99_1-50,45-52"))
    assert one(spark, fn.render_segments(fn.merge_segments(segs))) == "1-99"
    assert one(spark, fn.render_segments(fn.merge_segments(fn.parse_segments(F.lit("1-50_60-99"))))) == "1-50_60-99"
    assert one(spark, fn.chop_sequence(F.lit("ABCDEFGH"), fn.parse_segments(F.lit("2-3_6-8")))) == "BCFGH"
    for bad in ("1-", "x", "1-2_"):
        with pytest.raises(Exception, match="not segments"):
            one(spark, fn.parse_segments(F.lit(bad)))
    with pytest.raises(Exception, match="beyond"):
        one(spark, fn.chop_sequence(F.lit("ABC"), fn.parse_segments(F.lit("2-5"))))


def test_hypergeometric(spark):
    assert one(spark, fn.hypergeom_pmf(F.lit(5.0), F.lit(10.0), F.lit(4.0), F.lit(2.0))) == pytest.approx(450 / 1365, rel=1e-8)
    assert one(spark, fn.hypergeom_pmf(F.lit(5.0), F.lit(10.0), F.lit(4.0), F.lit(9.0))) == 0


def test_hierarchy_match(spark):
    assert one(spark, fn.hierarchy_match(F.lit("1.10.8"), "1.10")) and not one(spark, fn.hierarchy_match(F.lit("1.100.8"), "1.10"))
    with pytest.raises(ValueError):
        fn.hierarchy_match(F.lit("1"), "1.x")


def test_three_digits_round_as_c(spark):
    values = [198500.0, 65450.0, 9725.0, 432500.0, 1.125, 1.135, 1.005, 0.0, -65450.0, 1e-310, None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", fn.three_digits(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [None if x is None else float(f"{x:.2e}") for x in values]
