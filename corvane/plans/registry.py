"""A list of queries under names, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        """Registers a function of (read, spark), where read(name) is a table and read.folder their folder; its name is the query's."""

        def put(f: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
                read.folder = sf_dir
                return f(read, spark)

            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put
