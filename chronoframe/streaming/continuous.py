"""Continuous ingest and downsampling with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import lineprotocol


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.format("text").options(**options).load(path)


def read_table(spark: SparkSession, path: str, like: DataFrame, **options: str) -> DataFrame:
    return spark.readStream.schema(like.schema).format("parquet").options(**options).load(path)


def ingest(lines: DataFrame, write: Callable[[DataFrame], int], errors: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch's good points go to ``write``, its bad lines to a folder. Writes are last-write-wins, so a batch that runs again changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        parsed = lineprotocol.parse(df).persist()
        try:
            write(lineprotocol.good(parsed))
            lineprotocol.errors(parsed).write.mode("overwrite").parquet(f"{errors}/batch={number}")
        finally:
            parsed.unpersist()

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def deduplicate(df: DataFrame, keys: list[str], time: str = "time", delay: str = "1 hour") -> DataFrame:
    """Drops copies that arrive within the watermark; state is bounded by it."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def downsample(df: DataFrame, time: str, interval: str, tags: list[str], aggregates: list[Column], delay: str | None = "1 hour") -> DataFrame:
    """Tumbling windows by tags. With a watermark late windows close, and append mode emits them once."""
    stamped = df.withColumn("_time", F.col(time).cast("timestamp"))  # watermarks need a zoned timestamp
    stamped = stamped.withWatermark("_time", delay) if delay else stamped
    out = stamped.groupBy(F.window("_time", interval).alias("w"), *tags).agg(*aggregates)
    return out.select((F.unix_micros(F.col("w.start")) * 1000).alias("time"), *[c for c in out.columns if c != "w"])


def run_to_table(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All available input into an in-memory table (tests and small results)."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
