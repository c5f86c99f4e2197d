"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.session import table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def texts(self, name: str) -> DataFrame:
        """A table whose rows take long to work on, on all cores."""
        return texts(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of `Tables` as a query, with its SQL if there is one."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


def sql_list(values: list[str]) -> str:
    """Values as a list of SQL strings."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
