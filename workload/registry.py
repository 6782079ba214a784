"""The register of queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .fixtures import table, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables and fixtures of one scale by name: ``t.orders_src``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.built = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name, self.built)


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, days and times as text: values both engines hand out alike."""
    def cast(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string").alias(f.name)
        return c

    return df.select(*[cast(f) for f in df.schema])


def register(name: str, sql: str | None = None, also: str = ""):
    """Register ``build(tables) -> DataFrame`` under a name, with the SQL that gives the same rows."""
    def keep(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: portable(build(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLE[name] = with_fixtures(sql, also)
        return build

    return keep
