"""Tables that a stream grows batch by batch.

Every micro-batch writes its own folder ``batch=<id>`` and reads only earlier ones, so a
batch that is repeated after a lost executor or a restart replaces its own output and
gives the same rows: the tables are exactly-once without a transaction log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vouchspark.sources.stored import read_or_empty


def write_batch(df: DataFrame, root: str, table: str, batch: int, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{table}/batch={batch}")


def read_table(spark: SparkSession, root: str, table: str, schema: T.StructType | str, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one; empty while nothing was written.  Batches that
    were compacted are read from the compacted folder alone."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType(), True)])
    upto = compacted_upto(spark, root, table)
    found = read_or_empty(spark, f"{root}/{table}", full)
    if upto is not None:
        old = spark.read.schema(full).parquet(f"{root}/{table}_compacted/upto={upto}")
        found = old.select(*full.names).unionByName(found.filter(F.col("batch") > upto).select(*full.names))
    return found if before is None else found.filter(F.col("batch") < before)


# --- compaction ---------------------------------------------------------------------------
COMPACTIONS = "table string, upto long"


def compacted_upto(spark: SparkSession, root: str, table: str) -> int | None:
    """Last batch that a finished compaction of the table took in."""
    done = read_or_empty(spark, f"{root}/compactions", COMPACTIONS)
    return done.filter(F.col("table") == table).agg(F.max("upto")).first()[0]


def compact_table(spark: SparkSession, root: str, table: str, schema: T.StructType | str, partition_by: list[str] | None = None) -> int | None:
    """Rewrite all batches of a table but the newest into one folder, with few files per partition.

    The newest one stays, since a restarted stream may write it again.  Readers turn to the new
    folder once it is whole and recorded; only then the old folders go.  A run that dies earlier
    leaves readers with what they had.  Run it between streams.  Returns the last batch taken in."""
    newest = read_or_empty(spark, f"{root}/{table}", "batch long").agg(F.max("batch")).first()[0]
    before = compacted_upto(spark, root, table)
    if newest is None or newest < 1 or before == newest - 1:
        return before
    upto = newest - 1
    rows = read_table(spark, root, table, schema, before=newest)
    if partition_by:
        rows = rows.repartition(*partition_by)
    writer = rows.write.mode("overwrite")
    # ``batch`` stays a column of the rows here, not a folder.
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{table}_compacted/upto={upto}")
    record = spark.createDataFrame([(table, upto)], COMPACTIONS)
    record.coalesce(1).write.mode("append").parquet(f"{root}/compactions")
    remove_folders(spark, [f"{root}/{table}/batch={n}" for n in range(upto + 1)] + ([f"{root}/{table}_compacted/upto={before}"] if before is not None else []))
    return upto


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Start a stream over ``each``; ``once`` takes what is there now and stops."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrival_order(batch: int | None, column: str):
    """Order text by arrival first: batch number, then the event's own time."""
    number = F.col("batch") if batch is None else F.lit(batch)
    return F.concat_ws("|", F.lpad(number.cast("string"), 12, "0"), F.col(column))


def own_time(column: str):
    return F.substring(F.col(column), 14, 64)
