"""Structured streams over the events table: read as a stream, run to its end, and returned as the table the sink holds.

Sinks and checkpoints lie in the folder that all executors share, so a stream that loses an executor goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import shared_folder, table

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events as a stream of files (one file, or a folder of parts), with event time as a timestamp."""
    reader = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all there is and return its result.

    ``complete`` results replace each other, ``append`` results add up, one folder a batch; batches that are run again after a
    failure overwrite their own folder.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'all' if mode == 'complete' else f'batch={number}'}")

    writer = stream.writeStream.outputMode(mode).queryName(f"{name}_{folder[-8:].replace('-', '_')}").foreachBatch(keep)
    writer.option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    path = f"{folder}/all" if mode == "complete" else folder
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


TUMBLE_SQL = "SELECT date_trunc('day', ts) AS start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"


def _sum() -> F.Column:
    return F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")


@query("stream_tumbling", TUMBLE_SQL)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type, under a watermark."""
    rows = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), _sum())
    return drained(rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "complete", "tumbling")


@query("stream_sliding", "SELECT CAST(s AS TIMESTAMP) AS start, COUNT(*) AS n FROM (SELECT time_bucket(INTERVAL '12 hours', ts) - to_hours(12 * CAST(k AS INTEGER)) AS s, ts FROM events CROSS JOIN (VALUES (0), (1)) AS v(k)) AS t GROUP BY 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a day, every half day."""
    rows = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return drained(rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "complete", "sliding")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sightings of user and type; state holds the pairs seen."""
    return drained(events(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append", "dedup")


@query("stream_static_left", "SELECT event_id, r_name FROM events LEFT JOIN region ON user_id % 7 = r_regionkey")
def stream_static_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream beside a fixed dimension; the left join keeps events that match nothing."""
    region = F.broadcast(table(spark, sf_dir, "region"))
    rows = events(spark, sf_dir).join(region, F.col("user_id") % 7 == F.col("r_regionkey"), "left").select("event_id", "r_name")
    return drained(rows, "append", "static")


@query("stream_session", """SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM (
  SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM events) AS a) AS b GROUP BY user_id, session""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user on the stream."""
    rows = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return drained(rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n"), "complete", "session")


def running_totals(stream: DataFrame) -> DataFrame:
    """Custom state: each user's running count and sum, updated a batch at a time."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key, batches, state: GroupState):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
