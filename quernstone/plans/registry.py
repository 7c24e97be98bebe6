"""Registration of queries on the shared tables, each with DuckDB SQL for the same rows where SQL has them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.session import ship_package

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, python: bool = False):
    """Register a query; ``sql`` is its oracle, ``python`` says that executors import this package."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if python:
                ship_package(spark)
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
