"""Queries over the events: windows, sessions, the batch queue and the streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import table
from leadloom.streaming import events as E

from .registry import query


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_DAY = "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


@query(_DAY)
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows by type (extension)."""
    return _plain(E.tumbling(_events(spark, d)))


@query("SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS start FROM events) GROUP BY start")
def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two days that start every day (extension)."""
    return _plain(E.sliding(_events(spark, d)))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 12 HOUR)::TIMESTAMP AS finish, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of a user without a gap of twelve hours (extension)."""
    return _plain(E.sessions(_events(spark, d)))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'signup' ORDER BY value DESC, ts, event_id LIMIT 5")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    """The five jobs that free workers would take: highest priority, oldest first (a top-k report)."""
    return table(spark, d, "events").filter("event_type = 'signup'").orderBy(F.desc("value"), "ts", "event_id").limit(5).select("event_id", "user_id", "value")


@query("SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, date_trunc('day', ts)::DATE)")
def stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type and day with subtotals (extension)."""
    return table(spark, d, "events").withColumn("day", F.to_date("ts")).rollup("event_type", "day").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 300 SECOND")
def stale_events(spark: SparkSession, d: str) -> DataFrame:
    """Failed work whose lease of 300 s has run out at a given clock."""
    clock = F.lit("2024-01-30 23:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 300 SECOND")
    return table(spark, d, "events").filter((F.col("event_type") == "error") & (F.col("ts") < clock)).select("event_id", "user_id")


@query(_DAY)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The daily windows by a streaming query run to the end of its input."""
    return _plain(E.run_to_end(E.tumbling(E.read_events(spark, f"{d}/events.parquet")), "complete"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events once each through the watermark, then counted."""
    once = E.run_to_end(E.once_per_event(E.read_events(spark, f"{d}/events.parquet").select("event_id", "event_type", "ts")))
    return once.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*)::INTEGER AS seen, (count(*) FILTER (event_type = 'error'))::INTEGER AS errors, CASE WHEN count(*) FILTER (event_type = 'error') >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status FROM events GROUP BY user_id")
def queue_stream(spark: SparkSession, d: str) -> DataFrame:
    """Per-user counts by arbitrary state, the last state of every user."""
    states = E.run_to_end(E.user_states(E.read_events(spark, f"{d}/events.parquet").select("user_id", "event_type")), "update")
    return states.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max("errors").alias("errors"), F.max_by("status", "seen").alias("status"))
