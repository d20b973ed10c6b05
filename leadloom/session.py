"""Session helpers: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "leadloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects everywhere: UTC and adaptive execution."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only the columns a query touches are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: spark.checkpoint.dir where the cluster names one.

    Where it is unset a temporary folder is made, but only in local mode: on a cluster no machine-local
    folder would survive the loss of an executor, so there the missing setting is an error.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="leadloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


_planning = threading.Lock()
_tables: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives lost executors. Keeps its partitioning.

    parts: shuffle partitions for this step alone, where df is known to be small for the session's number.

    A checkpoint also carries the plan's constraints along; over many rounds these grow until planning takes
    longer than running, so their propagation is off while the checkpoint is made. These settings belong to the
    session, so threads that share one session take turns.
    """
    spark = df.sparkSession
    shared_dir(spark)
    now = {"spark.sql.constraintPropagation.enabled": "false"} | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    with _planning:
        before = {k: spark.conf.get(k) for k in now}
        try:
            for k, v in now.items():
                spark.conf.set(k, v)
            return df.checkpoint(eager=True)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)


def saved(df: DataFrame) -> DataFrame:
    """Like cut, but as a compressed columnar table: for wide or long rows of which later steps read some columns.

    The result isn't partitioned as df was. release() deletes the tables when no result needs them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what saved() wrote for this session; call it once the results are taken. Returns the number of tables."""
    mine = [p for s, p in _tables if s is spark]
    jvm = spark.sparkContext._jvm
    for p in mine:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _tables[:] = [(s, p) for s, p in _tables if s is not spark]
    return len(mine)


def small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most max_rows rows, else df as it is.

    The proof reads max_rows + 1 rows at most. Beyond the bound the planner chooses the join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores where the scan itself has fewer partitions, as with one small file.

    For work that costs far more per row than moving the row; a scan with enough partitions stays as it is.
    df must be free of shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def respread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows evenly, or by keys, over the usual number of shuffle partitions, before work that is heavy for its rows' size."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
