"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "vouchspark", master: str | None = None, **extra: str) -> SparkSession:
    """Session with adaptive execution on.  Skewed joins are split at run time, even
    where that costs one more shuffle, because one key may hold a third of all rows."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Groups are cut to their first rows before a shuffle up to this number of rows.
        "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session without that
    setting gets a scratch folder; on a cluster a missing setting is an error, since
    executors cannot see one machine's temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    scratch = tempfile.mkdtemp(prefix="vouchspark-")
    context.setCheckpointDir(scratch)
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, for tables that are read
    several times, a few columns each."""
    path = f"{checkpoint_root(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let files of shuffles and checkpoints go that no table uses any more.  Spark does so when the
    driver collects its garbage, which one that has little to do may put off until a job of many
    steps is over, so that the files of all steps lie on the disk at once."""
    spark.sparkContext._jvm.System.gc()
