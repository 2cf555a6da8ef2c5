"""Resumable processing: by completed keys, by append-only logs, by available-now streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corvelo.operators.records import complement


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not done."""
    return complement(work, done, keys)


def append_once(log_path: str, rows: DataFrame, request_id: str = "request_id") -> None:
    """Appends rows whose request is not in the log yet; repeats within `rows` count once."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(log_path)
    fresh = rows.dropDuplicates([request_id])
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        fresh = fresh.join(spark.read.parquet(log_path).select(request_id), request_id, "left_anti")
    fresh.write.mode("append").parquet(log_path)


def process_available(spark: SparkSession, source: str, schema: StructType, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str, files_per_batch: int = 100) -> StreamingQuery:
    """Runs `step` over the files that arrived since the last run and appends results by key once; a run
    that ends early goes on from its checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    write = lambda batch, _: append_once(sink, step(batch), key)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts per window and key of a stream or table, rows later than the watermark left out of streams."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def expire(cache: DataFrame, now: str, days: int, at: str = "retrieved_at") -> DataFrame:
    """Rows of a cache that are still valid at a given time."""
    return cache.where(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))
