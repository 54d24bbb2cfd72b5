"""A named set of queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name, with SQL where SQL can say the same."""

        def add(run: Query) -> Query:
            self.queries[run.__name__] = run
            if sql is not None:
                self.sql[run.__name__] = sql
            return run

        return add

    def merge(self, other: "Registry") -> None:
        if twice := self.queries.keys() & other.queries.keys():
            raise ValueError(f"queries registered twice: {sorted(twice)}")
        self.queries |= other.queries
        self.sql |= other.sql


def table(spark: SparkSession, folder: str, name: str, deal: str | None = None) -> DataFrame:
    """A table; with ``deal`` its rows are dealt out by that column when its files make fewer tasks than cores.

    For work that is heavy per row: a small file is one task, however long its texts take.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if deal is None or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, deal)
