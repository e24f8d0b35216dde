"""Databases and matrices: parameters, ranges, pushed filters, files of several kinds."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrospark.sources import jdbc, matrix, text

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_select():
    assert jdbc.select("a = :x AND b IN :many AND c = ':x' AND d::int > :n", x="it's", many=[1, 2], n=2.5) == "a = 'it''s' AND b IN (1, 2) AND c = ':x' AND d::int > 2.5"
    assert jdbc.select("d > :d AND e IS :e", d=datetime.date(2020, 1, 2), e=None) == "d > DATE '2020-01-02' AND e IS NULL"
    assert jdbc.select("x IN :none", none=[]) == "x IN (NULL)"
    for bad in ({}, {"x": 1, "y": 2}):
        with pytest.raises(KeyError):
            jdbc.select("a = :x", **bad)
    with pytest.raises(ValueError):
        jdbc.literal(float("nan"))


def test_database(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:sources"
    rows = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    jdbc.write_table(rows.unionByName(spark.createDataFrame([(None, "none")], "k long, name string")), f"{url};create=true", "items", "name VARCHAR(20)", **DERBY)
    got = jdbc.read_query(spark, url, jdbc.select('SELECT "k", "name" FROM items WHERE "name" <> :n', n="n7"), "k", **DERBY)
    assert got.rdd.getNumPartitions() == 8
    assert got.count() == 1000 and got.where("k is null").count() == 1
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r[1] for r in sizes) < 200
    plan = got.where("k > 990").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,990)" in plan and "name" not in plan.split("ReadSchema")[1]
    assert got.where("k > 990").count() == 9
    assert jdbc.read_query(spark, url, 'SELECT "k" FROM items WHERE 1 = 0', "k", **DERBY).count() == 0


def test_lists(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:lists;create=true"
    jdbc.write_table(spark.range(50).select(F.col("id").alias("k")), url, "ks", **DERBY)
    calls = []
    own = jdbc.read_query
    jdbc.read_query = lambda s, u, q: calls.append(q) or own(s, u, q, **DERBY)
    try:
        got = jdbc.read_lists(spark, url, 'SELECT "k" FROM ks WHERE "k" IN :ids AND "k" > :low', "ids", [1, 2, 3, 3, 40, 99], chunk=2, low=1)
    finally:
        jdbc.read_query = own
    assert len(calls) == 3 and sorted(r.k for r in got.collect()) == [2, 3, 40]


@pytest.mark.parametrize("kind", ["npy", "npz", "npz_compressed"])
def test_matrices(spark, tmp_path, kind):
    rows = [(f"v{i}", [float(i), i / 2, -1.0]) for i in range(250)]
    vectors = spark.createDataFrame(rows, "name string, embedding array<double>")
    path = f"file://{tmp_path}/m"
    assert matrix.write_matrix(vectors.repartition(2, "name"), path, kind, "f8") == 250
    got = matrix.read_matrix(spark, path, 40)
    assert sorted((r.name, r.embedding) for r in got.collect()) == sorted(rows)
    spark.dataSource.register(matrix.MatrixSource)
    parts = spark.read.format("numpy_matrix").options(path=path, rows="40").load().rdd.getNumPartitions()
    assert parts == 2 if kind == "npz_compressed" else parts >= 7
    some = spark.createDataFrame([("v3",), ("v200",), ("other",)], "name string")
    assert sorted(r.name for r in matrix.read_matrix(spark, path, 40, some).collect()) == ["v200", "v3"]


def test_one_matrix_file_and_lost_names(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12, dtype="i4").reshape(4, 3))
    (tmp_path / "a.names").write_text("w\nx\ny\nz\n")
    got = matrix.read_matrix(spark, str(tmp_path), 2)
    assert [tuple(r) for r in got.orderBy("name").collect()] == [("w", [0, 1, 2]), ("x", [3, 4, 5]), ("y", [6, 7, 8]), ("z", [9, 10, 11])]
    (tmp_path / "a.names").write_text("w\nx\ny\n")
    with pytest.raises(Exception, match="don't match"):
        matrix.read_matrix(spark, str(tmp_path), 2).collect()
    np.save(tmp_path / "a.npy", np.asfortranarray(np.arange(12.0).reshape(4, 3)))
    assert matrix.rows_of(str(tmp_path / "a.npy"), 1, 3).tolist() == [[3, 4, 5], [6, 7, 8]]


def test_profile_reports_are_read_by_lines(spark, tmp_path):
    hit = "  1 {}   98.5 {} 1.7E-15   69.1   0.0   49    2-52      2-50  (50)"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a").write_text("\n".join(["Query         q1", "Neff 1", "", " No Hit   Prob", hit.format("m", "3E-5"), hit.format("n", "7"), hit.format("m", "1E-9"), "  ", "No 1", "Query  other", hit.format("late", "1")]))
    (tmp_path / "r" / "b").write_text("\n".join(["Query q2", " No Hit", *[hit.format(f"m{i % 50}", i) for i in range(5000)]]) + "\n")
    (tmp_path / "r" / "c").write_text("Query q3\n\nnothing\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = text.read_profile_hits(spark, str(tmp_path / "r"))
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == sorted([("q1", "m", 1e-9), ("q1", "n", 7.0), *[("q2", f"m{i}", float(i)) for i in range(50)]])
    files = [x for x in got.inputFiles()]
    assert not any(x.endswith(("/r/a", "/r/b")) for x in files)  # no report is a row
