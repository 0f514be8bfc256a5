"""Sinks: submissions, feature details and caches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_submission(df: DataFrame, path: str, key: str = "id", score: str = "score", name: str = "score") -> None:
    """K1, K2: CSV of (key, score), the score named ``score`` or ``is_member``."""
    df.select(key, F.col(score).alias(name)).write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str, key: str, features: list[str]) -> None:
    """K3, K5: CSV of the key and its features."""
    df.select(key, *features).write.mode("overwrite").option("header", True).csv(path)


def cached(spark: SparkSession, folder: str, name: str, settings: dict, make) -> DataFrame:
    """K4: the Parquet cache of a feature table, under the hash of all settings that it depends on; made if it isn't there."""
    digest = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{digest}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown(df: DataFrame) -> str:
    """K6: a small result as a Markdown table."""
    rows = df.collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows])


def preview(df: DataFrame, columns: list[str], order: str, n: int = 3) -> DataFrame:
    """K8: the first n rows by key, with other columns than ``columns`` left out (pictures aren't shown)."""
    return df.select(*columns).orderBy(order).limit(n)
