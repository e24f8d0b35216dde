"""Joins of points with the intervals that hold them, as joins on equal keys.

An interval is a union of at most two dyadic segments a level: numbers that agree in all but their last ``level`` bits.
A point lies in one segment of each level. So each interval and each point become a few rows, a matching pair meets in exactly one of them, and no other pairs
meet: work follows input and output, and long intervals load no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(low: str, high: str, levels: str) -> Column:
    """The segments (level, at) that make up [low, high), of levels 0 to ``levels``. Arguments are SQL; low is not negative."""
    first, last = f"shiftright({low} + shiftleft(1L, k) - 1, k)", f"shiftright({high}, k)"
    left = f"IF({first} < {last} AND {first} % 2 = 1, named_struct('level', k, 'at', {first}), NULL)"
    right = f"IF({first} < {last} AND {last} % 2 = 1, named_struct('level', k, 'at', {last} - 1), NULL)"
    return F.expr(f"filter(flatten(transform(sequence(0, {levels}), k -> array({left}, {right}))), x -> x IS NOT NULL)")


def levels_of(most: str) -> str:
    """SQL of the levels that segments of numbers from 0 to ``most`` need."""
    return f"CAST(length(bin({most})) AS INT)"


def segment_rows(rows: DataFrame, low: str, high: str, most: str) -> DataFrame:
    """``rows`` once for each segment of [low, high), with level and at; empty intervals have none."""
    some = rows.where(f"{low} < {high}").withColumn("_s", F.explode(segments(f"CAST({low} AS BIGINT)", f"CAST({high} AS BIGINT)", levels_of(most))))
    return some.withColumns({"level": F.col("_s.level"), "at": F.col("_s.at")}).drop("_s")


def point_rows(rows: DataFrame, point: str, most: str) -> DataFrame:
    """``rows`` once for each level, with level and at."""
    return rows.withColumn("level", F.explode(F.expr(f"sequence(0, {levels_of(most)})"))).withColumn("at", F.expr(f"shiftright(CAST({point} AS BIGINT), level)"))


def containing(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, on: list[str], most: str = "most") -> DataFrame:
    """Each point with each interval [low, high) of the same ``on`` that holds it: columns of both.

    ``most``: a column of both sides, equal for equal ``on``: no less than any number there. Names other than ``on`` and ``most`` must differ.
    """
    a = point_rows(points, point, most)
    b = segment_rows(intervals, low, high, most).drop(most)
    return a.join(b, [*on, "level", "at"]).drop("level", "at")


def depth_at(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, on: list[str], most: str = "most", name: str = "n") -> DataFrame:
    """Each point with ``name``, how many intervals hold it: counts of equal segments are summed, pairs are never made."""
    many = segment_rows(intervals, low, high, most).groupBy(*on, "level", "at").agg(F.count("*").alias(name))
    own = [c for c in points.columns]
    met = point_rows(points, point, most).join(many, [*on, "level", "at"], "left")
    return met.groupBy(*own).agg(F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name))
