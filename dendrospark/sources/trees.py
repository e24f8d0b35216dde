"""Merge lists as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.functions import scalar as fn
from dendrospark.operators.windows import numbered


def trace_rows(merges: DataFrame) -> DataFrame:
    """Merges with steps from 1 and parents ``merge_node_k``, k above any such id among the leaves; missing scores as written out."""
    ids = merges.select("project", F.explode(F.array("child_a", "child_b")).alias("id")).join(merges.select("project", F.col("parent").alias("id")), ["project", "id"], "left_anti")
    number = F.regexp_extract("id", r"^merge_node_(\d+)$", 1)
    top = ids.where(number != "").groupBy("project").agg(F.max(number.cast("long")).alias("_top"))
    rows = numbered(merges, ["project"], [F.col("step")], "_n").join(top, "project", "left").withColumn("_to", F.concat(F.lit("merge_node_"), (F.col("_n") + F.coalesce("_top", F.lit(0))).cast("string")))
    names = rows.select("project", F.col("parent").alias("_old"), F.col("_to").alias("_new"))
    for side in ("child_a", "child_b"):
        own = names.withColumnsRenamed({"_old": side, "_new": f"_{side}"})
        rows = rows.join(own, ["project", side], "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    return rows.select("project", F.col("_n").alias("step"), "child_a", "child_b", F.col("_to").alias("parent"), fn.score_out(F.col("score")).alias("score"))


def write_traces(merges: DataFrame, path: str) -> None:
    """One folder a project, of tab-separated rows in step order."""
    rows = trace_rows(merges).repartition("project").sortWithinPartitions("project", "step")
    line = F.concat_ws("\t", "child_a", "child_b", "parent", F.col("score").cast("string"))
    rows.select("project", line.alias("value")).write.partitionBy("project").text(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Merges from four-column files; the project is the file's name up to its last dot. Other lines are an error."""
    lines = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("project"), F.posexplode(F.split(F.regexp_replace("value", r"\n+$", ""), "\n")).alias("step", "line")
    )
    cols = F.split("line", "\t")
    good = F.when(F.size(cols) == 4, cols).otherwise(F.raise_error(F.concat(F.lit("not a merge: "), F.col("line"))).cast("array<string>"))
    rows = lines.select("project", (F.col("step") + 1).cast("long").alias("step"), good.alias("c"))
    return rows.select("project", "step", F.col("c")[0].alias("child_a"), F.col("c")[1].alias("child_b"), F.col("c")[2].alias("parent"), F.col("c")[3].cast("double").alias("score"))


def read_old_traces(spark: SparkSession, path: str) -> DataFrame:
    """The older form: two lines a merge, one for each child; the parent is the second-last column, the score the third-last."""
    lines = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("project"), F.posexplode(F.split(F.regexp_replace("value", r"\n+$", ""), "\n")).alias("at", "line")
    )
    c = F.split(F.trim("line"), r"\s+")
    rows = lines.select("project", F.floor(F.col("at") / 2).cast("long").alias("step"), (F.col("at") % 2).alias("side"), F.get(c, F.lit(0)).alias("child"), F.element_at(c, -2).alias("parent"), F.element_at(c, -3).cast("double").alias("score"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("child")))
    out = rows.groupBy("project", "step").agg(pick(0).alias("child_a"), pick(1).alias("child_b"), F.max("parent").alias("parent"), F.max("score").alias("score"))
    return out.withColumn("step", F.col("step") + 1).select("project", "step", "child_a", "child_b", "parent", "score")
