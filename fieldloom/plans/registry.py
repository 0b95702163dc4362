"""The driver's queries by name, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import folder
from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ship(spark), sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def folder(self, label: str) -> str:
        return folder(self.spark, label)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def upper(c: str) -> str:
    return f"upper(replace({c}, 'ß', 'ss'))"


def compact(c: str) -> str:
    return f"regexp_replace({upper(c)}, '[^A-Z0-9]', '', 'g')"


def norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({upper(c)}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
