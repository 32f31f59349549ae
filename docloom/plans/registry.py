"""How query modules register: a function, its operator ids and, where SQL can say the same, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def register(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle:
                oracles[f.__name__] = oracle
            return f

        return add

    return queries, oracles, register
