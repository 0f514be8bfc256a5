"""Scans of the stored tables and caches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One lazily read Parquet table; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_delivery(df: DataFrame, key: str = "id", by: str = "loaded_at", columns: list[str] | None = None) -> DataFrame:
    """One row per key: the row with the greatest ``by``; among equal ones the greatest remaining values decide.

    ``max_by`` combines before the shuffle, so a key that holds a third of the rows costs one row a map task.
    Rows with a null key are dropped; a null ``by`` counts as earliest.
    """
    rest = [c for c in (columns or df.columns) if c != key]
    order = F.struct(F.col(by).isNotNull(), F.col(by), *[F.col(c) for c in rest if c != by and "map" not in dict(df.dtypes)[c]])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("__r"))
    return best.select(key, *[F.col("__r").getField(c).alias(c) for c in rest])


def spread(df: DataFrame, key: str, scan: bool = False) -> DataFrame:
    """df over at least as many tasks as there are cores, by key: for stages whose work a byte is large, which a planner that goes by bytes gives to a few tasks.

    scan: df only reads a table, and stays as it is if that has tasks enough.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if scan and df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n if scan else max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def with_retries(make: Callable[[], DataFrame], attempts: int = 5, wait: float = 5.0) -> DataFrame:
    """What ``make`` gives, tried again up to ``attempts`` times, the n-th time after n waits; lost tasks are Spark's own business."""
    for n in range(1, attempts + 1):
        try:
            return make()
        except (PySparkException, OSError):
            if n == attempts:
                raise
            time.sleep(wait * n)
    raise ValueError("attempts must be positive")


def join_if_present(left: DataFrame, right: DataFrame | None, key: str = "id") -> DataFrame:
    """The inner join on the key, or the left side alone where there is no right one."""
    return left if right is None else left.join(right, key)


def read_json_cache(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A feature cache of JSON records, with a declared schema so that no pass infers it."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv_cache(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A feature cache of CSV files with a header and a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
