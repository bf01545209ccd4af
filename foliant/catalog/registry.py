"""Registry of queries and of the SQL their results are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, by name, and SQL over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Rows of a statement that Spark and the checking engine both understand."""
        words = set(text.replace("(", " ").replace(")", " ").split())
        for name in words & set(TABLES):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def spread(self, text: str) -> DataFrame:
        """As :meth:`sql`, over all cores where the table is one small file."""
        return spread(self.sql(text))


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` as a query, with the SQL that gives the same rows."""

    def add(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return add
