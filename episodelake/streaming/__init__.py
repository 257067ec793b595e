"""Frames that arrive as a stream: checked by the same detectors as tables, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from episodelake.operators.warehouse import build_sync


def valid(frames: DataFrame) -> DataFrame:
    """Frames that may be appended: keys, a finite timestamp of at least 0, and vectors of 14."""
    return frames.where("episode_index is not null and frame_index is not null and timestamp >= 0 and timestamp < double('infinity') and size(action) = 14")


def collect(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends valid frames of new files under `source` to out/frames, others to out/rejected, and each batch's clock check to out/sync.

    A batch writes to a folder of its own number and overwrites it, so one that is run again after a failure leaves no copies."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        good = valid(df)
        good.write.mode("overwrite").parquet(f"{out}/frames/batch={number}")
        df.exceptAll(good).write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        build_sync(good).write.mode("overwrite").parquet(f"{out}/sync/batch={number}")
        df.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rates(frames: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Frames per robot and window of arrival; rows later than `delay` are left out."""
    return frames.withWatermark("ingested_at", delay).groupBy(F.window("ingested_at", window), "robot").agg(F.count("*").alias("n"))
