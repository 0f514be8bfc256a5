"""Session-level settings shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Parameters of the audit operators; the defaults are those of the audits."""

    max_tokens: int = 1024
    neighbours: int = 5
    drop_ratio_percent: int = 10
    min_k_percent: int = 20
    caption_words: int = 300
    clip_chars: int = 300
    negatives: int = 3
    target_fpr: float = 0.1
    seed: int = 42
    epsilon: float = 1e-8


DEFAULT = EngineConfig()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's own setting. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    set_by_cluster = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not set_by_cluster and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(set_by_cluster or tempfile.mkdtemp(prefix="auditloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


_WRITTEN: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, so that later branches read it again instead of recomputing it.

    The table is columnar and compressed, and its size is known to the planner. ``release`` removes it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete the tables written so far. Call it when the results of a query have been read, or else it is done when Python ends."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before
            return


def local_session(app: str = "auditloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
