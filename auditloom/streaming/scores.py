"""Streams: scored deliveries as they arrive, with late and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 16) -> DataFrame:
    """S2 as a stream: Parquet files of a folder, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_losses(stream: DataFrame, time: str = "scored_at", late: str = "30 days", width: str = "7 days") -> DataFrame:
    """(window, model, n, mean_loss) of the finite losses by event time; repeated rows within the watermark count once.

    Works on a stream and on a table. Null, NaN and infinite losses take no part; rows later than the watermark drop out of a stream.
    """
    own = stream.where(F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") < float("inf"))).withWatermark(time, late).dropDuplicates(["row_no", "batch_no", time])
    return own.groupBy(F.window(time, width), "model").agg(F.count("*").alias("n"), F.avg("loss").alias("mean_loss"))


def write_batches(stream: DataFrame, score, path: str, checkpoint: str):
    """Scores every micro-batch with ``score`` (DataFrame to DataFrame) and appends it to Parquet; restarts go on after the last whole batch."""

    def one(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
