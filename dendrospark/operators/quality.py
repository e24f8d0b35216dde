"""How well clusters agree with a reference partition.

Both are member tables: (cluster, item) and (class, item); an item may be in several classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def purity(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Share of clusters with exactly one class, of those with any."""
    n = clusters.join(classes, "item").groupBy("cluster").agg(F.countDistinct("class").alias("n"))
    return n.agg(F.avg((F.col("n") == 1).cast("double")).alias("purity"))


def contingency(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    return clusters.join(classes, "item").groupBy("cluster", "class").agg(F.count("*").alias("k"))


def edit_distance(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """2 * overlapping pairs - clusters - classes."""
    pairs = contingency(clusters, classes).agg(F.count("*").alias("o"))
    a = clusters.agg(F.countDistinct("cluster").alias("a"))
    b = classes.agg(F.countDistinct("class").alias("b"))
    return pairs.join(F.broadcast(a)).join(F.broadcast(b)).select((2 * F.col("o") - F.col("a") - F.col("b")).alias("edit_distance"))


def _entropy(sizes: DataFrame, total: DataFrame, name: str) -> DataFrame:
    p = F.col("n") / F.col("total")
    return sizes.join(F.broadcast(total)).agg(F.coalesce(F.sum(p * F.log(p)), F.lit(0.0)).alias(name))


def _total(classes: DataFrame) -> DataFrame:
    return classes.agg(F.count("*").alias("total"))


def entropy(clusters: DataFrame, classes: DataFrame, name: str = "entropy") -> DataFrame:
    """Sum of p ln p over clusters (not above 0), N being all class memberships."""
    return _entropy(clusters.groupBy("cluster").agg(F.count("*").alias("n")), _total(classes), name)


def mutual_information(clusters: DataFrame, classes: DataFrame, name: str = "mutual_information") -> DataFrame:
    return _entropy(contingency(clusters, classes).withColumnRenamed("k", "n"), _total(classes), name)


def variation_of_information(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """entropy(A) + entropy(B) - 2 * mutual information, in the signs of the above."""
    a = entropy(clusters, classes, "a")
    b = _entropy(classes.groupBy("class").agg(F.count("*").alias("n")), _total(classes), "b")
    m = mutual_information(clusters, classes, "m")
    return a.join(F.broadcast(b)).join(F.broadcast(m)).select((F.col("a") + F.col("b") - 2 * F.col("m")).alias("vi"))


def performance(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Purity, edit distance and variation of information in one figure, against all-singleton clusters."""
    single = clusters.select(F.col("item").alias("cluster"), "item").distinct()
    parts = purity(clusters, classes)
    for df, name, old in (
        (edit_distance(clusters, classes), "ed", "edit_distance"),
        (edit_distance(single, classes), "ed0", "edit_distance"),
        (variation_of_information(clusters, classes), "vi", "vi"),
        (variation_of_information(single, classes), "vi0", "vi"),
    ):
        parts = parts.join(F.broadcast(df.withColumnRenamed(old, name)))
    gain = lambda x, zero: F.when(F.col(zero) == 0, F.lit(0.0)).otherwise(100 - 100 * F.col(x) / F.col(zero))
    return parts.withColumn("performance", (2 * F.col("purity") * 100 + gain("ed", "ed0") + gain("vi", "vi0")) / 4)
