"""Intermediate tables and files in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vouchspark.session import checkpoint_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder below the checkpoint folder.  It is removed when the driver ends."""
    path = f"{checkpoint_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, and a lost
    executor costs no recomputation.  Runs one job."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
