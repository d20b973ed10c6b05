"""Windows over event streams, deduplication within a watermark and per-user state, batch and streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from leadloom.session import shared_dir


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per window and type."""
    w = F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    w = F.window("ts", size, step)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """(user_id, start, finish, n): runs of a user's events without a longer gap; finish includes the gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of files with an event-time column; path is a file or a folder, read as a pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream yields now, once, as a written table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:  # the last complete result replaces earlier ones
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def once_per_event(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without repeats that arrive within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


STATE = "errors int, seen int"
OUT = "user_id bigint, seen int, errors int, status string"


def fold_user(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts of one user's events and errors so far, carried between micro-batches; FAILED from the third error on."""
    errors, seen = state.get if state.exists else (0, 0)
    for b in batches:
        seen += len(b)
        errors += int((b["event_type"] == "error").sum())
    state.update((errors, seen))
    yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "errors": [errors], "status": ["FAILED" if errors >= 3 else "PENDING"]})


def user_states(stream: DataFrame) -> DataFrame:
    """(user_id, seen, errors, status) after every micro-batch, by arbitrary state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy("user_id").applyInPandasWithState(fold_user, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
