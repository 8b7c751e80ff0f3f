"""Streams over the events table, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.fanout import latest_per
from flowloom.plans.registry import query
from flowloom.sources.tables import table
from flowloom.streaming import streams


def events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    stream = streams.tail(spark, f"{d}/[e]vents.parquet", schema)  # a glob, as the table may be one file
    return stream.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))  # wall clock as UTC


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = streams.to_table(streams.window_counts(events(spark, d), "ts", ["event_type"], "1 day", "40 days"), "update", "windows")
    return latest_per(counts, ["start", "event_type"], "batch").select(F.date_format(F.to_utc_timestamp("start", F.current_timezone()), "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return streams.to_table(streams.first_of_each(events(spark, d), "ts", ["user_id", "event_type"], "40 days"), name="dedup").select("user_id", "event_type")


@query("""WITH e AS (SELECT user_id AS run, event_id AS seq, epoch_us(ts) // 1000 AS ms, event_type IN ('view', 'signup') AS s FROM events),
n AS (SELECT *, sum(s::INT) OVER w AS starts, sum((NOT s)::INT) OVER w AS ends FROM e WINDOW w AS (PARTITION BY run ORDER BY seq)),
l AS (SELECT *, greatest(max(ends - starts) OVER (PARTITION BY run ORDER BY seq), 0) AS lost FROM n),
p AS (SELECT *, coalesce(lag(lost) OVER (PARTITION BY run ORDER BY seq), 0) AS was FROM l)
SELECT e.run, e.seq, greatest(e.ms - b.ms, 0) AS elapsed_ms FROM p e JOIN p b ON b.s AND NOT e.s AND e.lost = e.was AND b.run = e.run AND b.starts = e.ends - e.lost""")
def stream_latencies(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), "ts", F.col("event_type").isin("view", "signup").alias("start"))
    return streams.to_table(streams.latencies(e, ["run"], "seq", "ts", "start", "40 days"), name="latencies").select("run", "seq", "elapsed_ms")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions end after six hours without an event; of complete results the last is the whole."""
    found = streams.to_table(streams.session_counts(events(spark, d), "ts", ["user_id"], "6 hours", "40 days"), "complete", "sessions")
    last = found.agg(F.max("batch").alias("batch"))
    start = F.date_format(F.to_utc_timestamp("start", F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return found.join(F.broadcast(last), "batch").select("user_id", start.alias("start"), "n")
