"""Incremental forms (L-01 to L-08): Structured Streaming over landed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url


def new_files(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """L-01, L-07: files that arrive, in bounded micro-batches; a checkpoint makes each count once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen_stream(items: DataFrame, time: str, delay: str = "45 days", key: Column | None = None) -> DataFrame:
    """L-06: the first item of each URL, without an index (`seen.SeenStore` has all layers); state is dropped, and later items with it, past the watermark."""
    keyed = items.withColumn("_key", normalize_url(F.col("source_url")) if key is None else key)
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def period_counts(items: DataFrame, time: str, key: str, period: str = "21 days", delay: str = "1 day") -> DataFrame:
    """L-03: items by key and period."""
    return items.withWatermark(time, delay).groupBy(F.window(time, period), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "n")


def breaker(calls: DataFrame, limit: int = 3) -> DataFrame:
    """L-05 over stored calls(client, at, ok, recoverable): whether the client is disabled by then. `limit` unrecoverable failures in a row open the breaker for good; a recoverable one ends the run, a success leaves it."""
    order = Window.partitionBy("client").orderBy("at")
    hard = ~F.col("ok") & ~F.col("recoverable")
    runs = calls.withColumn("_run", F.sum((~F.col("ok") & F.col("recoverable")).cast("int")).over(order))
    streak = runs.withColumn("_streak", F.when(hard, F.sum(hard.cast("int")).over(Window.partitionBy("client", "_run").orderBy("at"))).otherwise(0))
    return streak.withColumn("disabled", F.max(F.col("_streak") >= limit).over(order)).drop("_run", "_streak")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """L-08: handles all that has landed and stops, for a scheduler to call."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
