"""Streams over a table's files, run until all that is there has been read (L-01, L-03 to L-08)."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..registry import query
from ..shared import folder
from ..streaming import incremental, stateful
from .views import oracle

#: Seconds between polite slots of a host here.
_DELAY = 40


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as they would arrive: of a folder, or the one file of that name."""
    path = f"{sf_dir}/{table}.parquet"
    fields = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(fields).option("maxFilesPerTrigger", 4)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


@contextlib.contextmanager
def _provider(spark: SparkSession) -> Iterator[None]:
    """State of processors needs a provider of its own, which the session's other streams need not have."""
    name, value = stateful.PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives, kept in the checkpoint folder: batch by batch, or the last whole result."""
    spark = stream.sparkSession
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number if mode == 'append' else 0}")

    stream.writeStream.option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out").select(*stream.columns)


@query("SELECT event_type, time_bucket(INTERVAL 21 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY ALL")
def l03_period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(incremental.period_counts(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), "complete")


@query(f"""WITH r AS (SELECT event_id, user_id % 50 AS host, event_id + 1 AS t, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS k FROM events)
    SELECT 'host' || host AS host, CAST(event_id AS VARCHAR) AS item, true AS granted, CAST(max(t - k * {_DELAY}) OVER (PARTITION BY host ORDER BY k) + k * {_DELAY} - t AS DOUBLE) AS wait FROM r""")
def l04_polite_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every request is granted in the end: a slot is then the latest of what came before, a delay further for each
    asked = _stream(spark, sf_dir, "events").select(F.concat(F.lit("host"), F.col("user_id") % 50).alias("host"), F.col("event_id").cast("string").alias("item"), F.timestamp_seconds(F.col("event_id") + 1).alias("at"), F.lit(None).cast("double").alias("delay"))
    with _provider(spark):
        return _drained(stateful.polite_slots(asked, _DELAY, float("inf"), "3650 days")).select("host", "item", "granted", "wait")


@query("""WITH c AS (SELECT event_id, user_id % 200 AS client, event_type NOT IN ('click', 'view', 'error') AS ok, event_id % 7 > 1 AS hard FROM events), r AS (SELECT *, count(*) FILTER (NOT ok AND NOT hard) OVER w AS run FROM c WINDOW w AS (PARTITION BY client ORDER BY event_id)),
    s AS (SELECT *, CASE WHEN NOT ok AND hard THEN count(*) FILTER (NOT ok AND hard) OVER (PARTITION BY client, run ORDER BY event_id) ELSE 0 END AS streak FROM r)
    SELECT event_id, client, max(streak >= 3) OVER (PARTITION BY client ORDER BY event_id) AS disabled FROM s""")
def l05_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events")
    calls = e.select(
        (F.col("user_id") % 200).alias("client"), F.timestamp_seconds("event_id").alias("at"), (~F.col("event_type").isin("click", "view", "error")).alias("ok"),
        F.when(F.col("event_id") % 7 > 1, "Error: Incorrect API key provided").otherwise("timeout").alias("error"),
    )
    with _provider(spark):
        out = _drained(stateful.breaker_stream(calls.withColumn("client", F.col("client").cast("string")), lists.PERMANENT_ERRORS + lists.SPENT_ALLOWANCE))
    return out.select(F.unix_seconds("at").alias("event_id"), F.col("client").cast("long").alias("client"), "disabled")


@query(oracle("SELECT DISTINCT source_url FROM m_items"))
def l06_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events")
    items = e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("https://host"), F.col("user_id") % 50, F.lit(".example.com/a"), F.col("event_id") % 700).alias("source_url"))
    return _drained(incremental.first_seen_stream(items, "ts", "3650 days")).select("source_url")
