"""The registry of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy parquet tables of one data folder: ``t.documents`` and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self._spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def _spread(self, df: DataFrame) -> DataFrame:
        """Deal a table of fewer splits than cores over all of them.

        Text work costs far more than its bytes; a large table has enough
        splits and is read as it is.
        """
        if self.tasks == 1 or df.rdd.getNumPartitions() >= self.tasks:
            return df
        return df.repartition(self.tasks * 4)  # small pieces even out long texts

    @cached_property
    def tasks(self) -> int:
        return self.spark.sparkContext.defaultParallelism


def query(name: str, oracle: str | None = None):
    """Register ``fn(Tables) -> DataFrame`` with its SQL check."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
