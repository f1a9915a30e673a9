import time

from vouchspark.streaming import timers

ATTEMPT = "attempt_id long, approval_id long, ok boolean, at string"


def test_alarms(spark, tmp_path):
    """One failure comes up again, three are dead, a success and a settled action stay silent."""
    rows = [(1, 1, False, "t1"), (2, 2, False, "t1"), (3, 2, False, "t2"), (4, 2, False, "t3"), (5, 3, False, "t1"), (6, 3, True, "t2"), (7, 2, False, "t4")]
    spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(spark.createDataFrame([], ATTEMPT).schema).parquet(str(tmp_path / "in/*"))
    seen = []

    def keep(batch, number):
        seen.extend(tuple(r) for r in batch.collect())

    alarms = timers.retry_alarms(stream, backoff=1.0)
    query = (
        alarms.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(processingTime="1 second").start()
    )
    try:
        deadline = time.time() + 90
        while time.time() < deadline and (1, "retry", 1) not in seen:
            time.sleep(1)
            if query.exception():
                raise query.exception()
    finally:
        query.stop()
    assert sorted(set(seen)) == [(1, "retry", 1), (2, "dead", 3)]
