"""Queries of the job queue over the events, read as a log of jobs at a given clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.operators import queue
from leadloom.session import table

from .registry import query

CLOCK = "2024-01-20 00:00:00"
WORKER, SLOTS = "worker-1", 50
_NOW = f"TIMESTAMP '{CLOCK}'"
_JOBS = f"""j AS (SELECT event_id AS id, user_id AS search_job, event_type AS type, CASE WHEN event_type IN ('click', 'signup') THEN 'PENDING' WHEN event_type = 'view' THEN 'COMPLETED' ELSE 'PROCESSING' END AS status, floor(value)::INTEGER AS priority, (event_id % 4)::INTEGER AS attempts,
  3 AS max_attempts, CASE WHEN event_id % 5 = 0 THEN 'earlier' END AS last_error, ts + INTERVAL 1 DAY * (event_id % 3) AS available_at, CASE WHEN event_type IN ('error', 'purchase') THEN ts END AS locked_at, CASE WHEN event_type IN ('error', 'purchase') THEN 'worker-0' END AS locked_by, ts AS created_at FROM events)"""
_OUT = "id, status, attempts, last_error, available_at, locked_by"


def _clock():
    return F.lit(CLOCK).cast("timestamp")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    busy = F.col("event_type").isin("error", "purchase")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("search_job"), F.col("event_type").alias("type"), F.col("event_type").alias("stage"),
        F.when(F.col("event_type").isin("click", "signup"), "PENDING").when(F.col("event_type") == "view", "COMPLETED").otherwise("PROCESSING").alias("status"), F.floor("value").cast("int").alias("priority"),
        (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.when(F.col("event_id") % 5 == 0, "earlier").alias("last_error"),
        (F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 3).cast("int"))).alias("available_at"), F.when(busy, F.col("ts")).alias("locked_at"), F.when(busy, "worker-0").alias("locked_by"), F.col("ts").alias("created_at"),
    )


def _shown(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", "status", "attempts", "last_error", F.col("available_at").cast("timestamp_ntz").alias("available_at"), "locked_by")


@query(f"SELECT city AS id, 'DISCOVERY' AS type, 'DISCOVERY' AS stage, 'PENDING' AS status, 100 AS priority, 0 AS attempts, 3 AS max_attempts, {_NOW} AS available_at FROM lead_row WHERE city IS NOT NULL GROUP BY city")
def queue_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """One new job a city."""
    wanted = table(spark, d, "lead_row").filter("city is not null").select(F.col("city").alias("id"), F.lit(None).cast("string").alias("search_job"), F.lit("DISCOVERY").alias("type")).distinct()
    return queue.enqueue(wanted, _clock()).select("id", "type", "stage", "status", "priority", "attempts", "max_attempts", F.col("available_at").cast("timestamp_ntz").alias("available_at"))


@query(
    f"""WITH {_JOBS}, t AS (SELECT id FROM j WHERE status = 'PENDING' AND available_at <= {_NOW} ORDER BY priority DESC, created_at, id LIMIT {SLOTS})
    SELECT j.id, CASE WHEN t.id IS NOT NULL THEN 'PROCESSING' ELSE status END AS status, CASE WHEN t.id IS NOT NULL THEN attempts + 1 ELSE attempts END AS attempts, last_error, available_at, CASE WHEN t.id IS NOT NULL THEN '{WORKER}' ELSE locked_by END AS locked_by FROM j LEFT JOIN t USING (id)"""
)
def queue_claimed(spark: SparkSession, d: str) -> DataFrame:
    """All jobs after a worker with fifty free slots has taken the next ones."""
    return _shown(queue.claim(_jobs(spark, d), _clock(), WORKER, SLOTS))


@query(f"WITH {_JOBS} SELECT id, CASE WHEN type = 'purchase' THEN 'COMPLETED' ELSE status END AS status, attempts, last_error, available_at, CASE WHEN type <> 'purchase' THEN locked_by END AS locked_by FROM j")
def queue_complete(spark: SparkSession, d: str) -> DataFrame:
    """All jobs after the purchases are done."""
    jobs = _jobs(spark, d)
    return _shown(queue.complete(jobs, jobs.filter("type = 'purchase'").select("id")))


@query(
    f"""WITH {_JOBS}, f AS (SELECT *, type = 'error' AND status = 'PROCESSING' AS hit, id % 7 <> 0 AND attempts < max_attempts AND attempts <= 2 AS again FROM j)
    SELECT id, CASE WHEN NOT hit THEN status WHEN again THEN 'PENDING' ELSE 'FAILED' END AS status, attempts, CASE WHEN hit THEN left(repeat('timeout ', 600), 4000) ELSE last_error END AS last_error,
      CASE WHEN hit AND again THEN {_NOW} + INTERVAL 1 MILLISECOND * (CASE WHEN attempts <= 1 THEN {K.RETRY_MS[0]} ELSE {K.RETRY_MS[1]} END) ELSE available_at END AS available_at, CASE WHEN NOT hit THEN locked_by END AS locked_by FROM f"""
)
def queue_retry(spark: SparkSession, d: str) -> DataFrame:
    """All jobs after the running errors have failed with a long message, every seventh for good."""
    jobs = _jobs(spark, d)
    failed = jobs.filter("type = 'error' and status = 'PROCESSING'").select("id", F.repeat(F.lit("timeout "), F.lit(600)).alias("error"), (F.col("id") % 7 == 0).alias("permanent"))
    return _shown(queue.fail(jobs, failed, _clock()))


@query(
    f"""WITH {_JOBS}, f AS (SELECT *, coalesce(status = 'PROCESSING' AND locked_at < {_NOW} - INTERVAL {K.LEASE_SECONDS} SECOND, false) AS hit, attempts < max_attempts AS more FROM j)
    SELECT id, CASE WHEN NOT hit THEN status WHEN more THEN 'PENDING' ELSE 'FAILED' END AS status, attempts, CASE WHEN hit THEN coalesce(last_error, CASE WHEN more THEN '{queue.STALE}' ELSE '{queue.STALE_FAILED}' END) ELSE last_error END AS last_error,
      CASE WHEN hit AND more THEN {_NOW} ELSE available_at END AS available_at, CASE WHEN NOT hit THEN locked_by END AS locked_by FROM f"""
)
def queue_recover(spark: SparkSession, d: str) -> DataFrame:
    """All jobs after those whose lease ran out were taken back."""
    return _shown(queue.recover(_jobs(spark, d), _clock()))


@query(f"WITH {_JOBS} SELECT id, CASE WHEN search_job % 3 = 0 AND status IN ('PENDING', 'PROCESSING') THEN 'CANCELLED' ELSE status END AS status, attempts, last_error, available_at, CASE WHEN NOT (search_job % 3 = 0 AND status IN ('PENDING', 'PROCESSING')) THEN locked_by END AS locked_by FROM j")
def queue_cancel(spark: SparkSession, d: str) -> DataFrame:
    """All jobs after every third search job was called off."""
    jobs = _jobs(spark, d)
    return _shown(queue.cancel(jobs, jobs.filter("search_job % 3 = 0").select("search_job")))
