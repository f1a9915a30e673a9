"""Trace documents as JSON files laid out by year and month, and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchspark import schemas


def read_traces(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Traces under ``path`` with the fixed schema.  ``multi_line`` reads one pretty-printed
    document per file, the default one document per line."""
    return (
        spark.read.schema(schemas.TRACE).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    )


def write_traces(df: DataFrame, path: str, mode: str = "append") -> None:
    """One record per run, partitioned by year and month of ``started_at``.  Compressed: the field names of
    every call are most of the text."""
    dated = df.withColumn("year", F.substring("started_at", 1, 4)).withColumn("month", F.substring("started_at", 6, 2))
    dated.write.mode(mode).partitionBy("year", "month").json(path, compression="gzip")


def read_items(spark: SparkSession, path: str, source: str | None = None, n: int | None = None) -> DataFrame:
    """Benchmark items, optionally of one source, optionally the first ``n`` by id."""
    items = spark.read.schema(schemas.BENCHMARK_ITEM).json(path)
    if source is not None:
        items = items.filter(F.col("source_ds") == source)
    return items if n is None else items.orderBy("id").limit(n)
