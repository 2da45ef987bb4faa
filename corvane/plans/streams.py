"""Streaming queries, replayed over the events table until all of it has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import folder
from ..streaming import windows
from .registry import Registry

REGISTRY = query = Registry()


def events(read, spark) -> DataFrame:
    return spark.readStream.schema(read("events").schema).parquet(f"{read.folder}/events.parquet*")


def replayed(spark, stream: DataFrame, mode: str) -> DataFrame:
    """What the stream has put out when all data has been read, on the driver; the results of these queries are one row a group."""
    name = f"stream_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def appended(spark, stream: DataFrame) -> DataFrame:
    """What an appending stream has put out when all data has been read: Parquet in the shared folder, for results of as many rows as the stream has."""
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query("SELECT key, CAST(rank AS INTEGER) AS rank, value FROM (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rank FROM events WHERE value IS NOT NULL) WHERE rank <= 4")
def stream_k_least(read, spark):
    out = replayed(spark, windows.k_least(events(read, spark), "event_type", "value", 4), "update")
    last = out.groupBy("key").agg(F.max_by("least", F.struct(F.size("least"), -F.element_at("least", -1))).alias("least"))
    return last.select("key", F.posexplode("least").alias("rank", "value")).withColumn("rank", F.col("rank") + 1)


@query("""SELECT start, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start, value FROM events) GROUP BY start""")
def stream_overlapping_windows(read, spark):
    stream = events(read, spark).withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return replayed(spark, out, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 3).alias("total"))


@query("SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY ALL) GROUP BY user_id")
def session_windows(read, spark):
    e = read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("SELECT key, round(sum(value * pow(0.5, k)), 6) AS level FROM (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS k FROM events WHERE value IS NOT NULL) WHERE k < 1000 GROUP BY key")
def stream_recurrence(read, spark):
    out = replayed(spark, windows.carried(events(read, spark), "event_type", "value", 0.5, ["ts", "event_id"]), "update")
    last = out.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.monotonically_increasing_id().desc()))).where("_r = 1")
    return last.select("key", F.round("level", 6).alias("level"))


@query("WITH e AS (SELECT event_type AS key, event_id, ts, value FROM events WHERE value IS NOT NULL AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 86400000 FROM events)), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) - 1 AS k FROM e) SELECT key, count(*) AS n, round(sum(CASE WHEN k < 1000 THEN value * pow(0.5, k) ELSE 0 END), 6) AS level FROM r GROUP BY key")
def stream_in_time_order(read, spark):
    """The last level of each key up to a day before the end, from the table's files in any order."""
    stream = events(read, spark).withColumn("ts", F.col("ts").cast("timestamp"))
    out = appended(spark, windows.in_time_order(stream, "event_type", "ts", "value", 0.5, "1 day", "event_id"))
    return out.groupBy("key").agg(F.max("n").alias("n"), F.round(F.max_by("level", "n"), 6).alias("level"))
