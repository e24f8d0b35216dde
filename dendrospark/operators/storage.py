"""Tables kept between rounds of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which ``shuffled`` leaves it to Spark whether a table is sent to every task.
FEW = 50_000


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the folder in ``spark.checkpoint.dir``. Where none is set, a temporary one on this machine, if it is the only one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.dendrospark.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="dendrospark-")
        spark.conf.set("spark.dendrospark.scratch", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "round", path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (or ``path``) and read again: a cut lineage that survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame, name: str = "round") -> DataFrame:
    """As ``kept``, for tables whose joins are with others of their size: those of more than FEW rows meet by shuffles.

    Numbers in order take few bytes in a file and many in memory, so by the file's size Spark would collect millions of rows in the driver to broadcast them.
    """
    seen = Observation()
    out = kept(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out.hint("merge") if seen.get["n"] > FEW else out


def dealt(df: DataFrame, *keys: str, rows: int = 1 << 20) -> DataFrame:
    """``df`` by ``keys`` to as many tasks as have about ``rows`` rows each, counted first: by their bytes, narrow rows would be few tasks with many groups each."""
    return df.repartition(min(4096, df.count() // rows + 1), *keys)


class Rounds:
    """Tables of all rounds in one folder, so that what they have in common is one scan, however many they are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n, self.schema = spark, new_path(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        self.n, self.schema = self.n + 1, df.schema
        return kept(df, path=f"{self.path}/{self.n}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
