"""How a query is declared: a function of (spark, sf_dir) with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers the function under its own name; without SQL, tests compare it with brute force."""

    def mark(run: Callable[[SparkSession, str], DataFrame]):
        run.oracle = sql
        return run

    return mark


def _marked(module: ModuleType) -> dict[str, Callable]:
    return {name: f for name, f in vars(module).items() if callable(f) and hasattr(f, "oracle")}


def queries_of(module: ModuleType) -> dict[str, Callable]:
    return _marked(module)


def oracles_of(module: ModuleType) -> dict[str, str]:
    return {name: f.oracle for name, f in _marked(module).items() if f.oracle}
