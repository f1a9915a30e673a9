"""How the registered streams are fed."""

from pathlib import Path

from pyspark.sql import functions as F

from vouchspark.plans import stream_queries as Q
from vouchspark.streaming.tables import run_batches


def test_parts_are_held_once(spark, tmp_path):
    """A part that the stream has is not kept beside its input folder; every row is fed once."""
    seen, held = [], []

    def start(stream):
        held.append(sorted({p.parent.name for p in Path(tmp_path).glob("staged/_part=*/*.parquet")}))
        return run_batches(stream, lambda batch, number: seen.extend(r["id"] for r in batch.collect()), f"{tmp_path}/_progress")

    Q._run_parts(spark, spark.range(30).withColumn("_part", (F.col("id") % 3).cast("int")), str(tmp_path), 3, start)
    assert held == [["_part=1", "_part=2"], ["_part=2"], []]
    assert sorted(seen) == list(range(30))
