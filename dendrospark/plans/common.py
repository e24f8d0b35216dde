"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with its SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def add(plan: Plan) -> Plan:
            self.queries[name] = plan
            if sql:
                self.sql[name] = sql
            return plan

        return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
