"""A job queue as a table: every step takes the table of jobs and gives the table after it.

Jobs: (id, search_job, type, stage, status, priority, attempts, max_attempts, last_error, available_at, locked_at, locked_by, created_at).
A step is a projection over the jobs and, at most, a join with the ids it concerns, so it also serves as the merge
source of a table format. Jobs in no state that a step concerns pass through unchanged; null statuses never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import constants as K
from leadloom.functions import text

PRIORITY, MAX_ATTEMPTS, ERROR_LENGTH = 100, 3, 4_000
STALE, STALE_FAILED = "Stale lock recovered", "Stale lock exceeded max attempts"
_none = lambda kind: F.lit(None).cast(kind)


def enqueue(wanted: DataFrame, now: Column) -> DataFrame:
    """New jobs of rows (id, search_job, type) with, if given, stage, priority, max_attempts and available_at."""
    given = lambda c, default: F.coalesce(F.col(c), default) if c in wanted.columns else default
    return wanted.select(
        "id", "search_job", "type", given("stage", F.col("type")).alias("stage"), F.lit("PENDING").alias("status"), given("priority", F.lit(PRIORITY)).cast("int").alias("priority"), F.lit(0).alias("attempts"),
        given("max_attempts", F.lit(MAX_ATTEMPTS)).cast("int").alias("max_attempts"), _none("string").alias("last_error"), given("available_at", now).alias("available_at"),
        _none("timestamp").alias("locked_at"), _none("string").alias("locked_by"), now.alias("created_at"),
    )


def _change(jobs: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """Columns set to values where hit holds."""
    hit = F.coalesce(hit, F.lit(False))
    return jobs.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(jobs.schema[c].dataType) for c, v in values.items()})


def claim(jobs: DataFrame, now: Column, worker: str, slots: int) -> DataFrame:
    """Gives a worker the first pending jobs that are due: highest priority, then oldest, then smallest id.

    The top slots are taken by a bounded sort; their ids (at most slots) are broadcast back.
    """
    due = jobs.filter((F.col("status") == "PENDING") & (F.col("available_at") <= now))
    taken = due.orderBy(F.desc("priority"), "created_at", "id").limit(slots).select("id", F.lit(True).alias("_taken"))
    marked = jobs.join(F.broadcast(taken), "id", "left")
    return _change(marked, F.col("_taken"), status=F.lit("PROCESSING"), attempts=F.col("attempts") + 1, locked_at=now, locked_by=F.lit(worker)).select(jobs.columns)


def complete(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs whose id is in done (id) are finished and free."""
    marked = jobs.join(done.select("id", F.lit(True).alias("_done")).distinct(), "id", "left")
    return _change(marked, F.col("_done"), status=F.lit("COMPLETED"), locked_at=F.lit(None), locked_by=F.lit(None)).select(jobs.columns)


def fail(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Jobs of failures (id, error, permanent) wait for another attempt or have failed.

    Another attempt needs one left and a waiting time for it (retry_delay_ms), and no permanent error. Of several
    failures of a job the permanent one, then the smallest error counts. Errors keep their first 4,000 letters.
    """
    one = failures.groupBy("id").agg(F.min_by(F.struct(F.substring("error", 1, ERROR_LENGTH).alias("error"), "permanent"), F.struct((~F.coalesce("permanent", F.lit(False))).alias("p"), "error")).alias("_f"))
    marked = jobs.join(one, "id", "left").withColumn("_ms", text.retry_delay_ms(F.col("attempts")))
    hit = F.col("_f").isNotNull()
    again = ~F.coalesce(F.col("_f.permanent"), F.lit(False)) & (F.col("attempts") < F.col("max_attempts")) & F.col("_ms").isNotNull()
    at = now + F.make_dt_interval(secs=(F.col("_ms") / 1000).cast("decimal(18,6)"))
    return _change(
        marked, hit, status=F.when(again, "PENDING").otherwise("FAILED"), last_error=F.col("_f.error"), available_at=F.when(again, at).otherwise(F.col("available_at")),
        locked_at=F.lit(None), locked_by=F.lit(None),
    ).select(jobs.columns)


def recover(jobs: DataFrame, now: Column, lease_seconds: int = K.LEASE_SECONDS) -> DataFrame:
    """Jobs locked for longer than the lease are pending again, or have failed if no attempt is left."""
    stale = (F.col("status") == "PROCESSING") & (F.col("locked_at") < now - F.expr(f"INTERVAL {lease_seconds} SECOND"))
    left = F.col("attempts") < F.col("max_attempts")
    return _change(
        jobs, stale, last_error=F.coalesce("last_error", F.when(left, STALE).otherwise(STALE_FAILED)), available_at=F.when(left, now).otherwise(F.col("available_at")),
        locked_at=F.lit(None), locked_by=F.lit(None), status=F.when(left, "PENDING").otherwise("FAILED"),
    )


def cancel(jobs: DataFrame, search_jobs: DataFrame) -> DataFrame:
    """Waiting and running jobs of the given search jobs (search_job) are cancelled."""
    marked = jobs.join(search_jobs.select("search_job", F.lit(True).alias("_off")).distinct(), "search_job", "left")
    return _change(marked, F.col("_off") & F.col("status").isin("PENDING", "PROCESSING"), status=F.lit("CANCELLED"), locked_at=F.lit(None), locked_by=F.lit(None)).select(jobs.columns)
