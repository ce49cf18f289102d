"""Where queries and their DuckDB equivalents are registered, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under ``name``; ``oracle`` is the same query as DuckDB SQL, if SQL can say it."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return function

    return register


def same_sql(name: str, sql: str) -> None:
    """Register a query whose text means the same to Spark and DuckDB; tables stand in it as ``{table}``."""
    import re

    tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    query(name, re.sub(r"\{(\w+)\}", r"\1", sql))(run)


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for module in (
        "operators.spend operators.telemetry operators.joins operators.aggregates operators.windows operators.sets operators.issues operators.runs operators.lint "
        "operators.code operators.code_cases functions.scalar functions.types plans.queries plans.cases streaming.queries"
    ).split():
        importlib.import_module(f"plumbline.{module}")
