"""Retry alarms: a keyed state with processing-time timers over the attempt stream.

``streaming.approvals.stream_attempts`` keeps the execution table and is the skew-safe way
to fold attempts.  This stream only says *when* something is due: a failed action comes up
for its next try after the backoff, and one that used up its tries is reported once.  Feed
it the attempts that count (the ``attempts`` table of that stream), at most the allowed
failures and one success per approval, so that no key holds more than a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vouchspark.operators.approvals import BACKOFF_SECONDS, MAX_ATTEMPTS
from vouchspark.session import ROCKSDB

ALARM = "approval_id long, alarm string, failures int"
STATE = "status string, failures int"
#: Milliseconds after its last attempt in which the state of an approval ends.
KEEP_MS = 90 * 24 * 3600 * 1000


class RetryAlarms(StatefulProcessor):
    """Per approval: how often it failed, and whether it is settled."""

    def __init__(self, max_attempts: int, backoff: float, keep_ms: int = KEEP_MS) -> None:
        self.max_attempts, self.backoff, self.keep_ms = max_attempts, backoff, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("execution", STATE, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, failures = self.state.get() if self.state.exists() else ("pending", 0)
        before = status
        for frame in rows:
            for ok in frame.sort_values(["at", "attempt_id"])["ok"]:
                if status == "pending":
                    failures += not ok
                    status = "succeeded" if ok else "dead" if failures >= self.max_attempts else "pending"
        self.state.update((status, int(failures)))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if status == "pending":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.backoff * 1000))
        elif status == "dead" and before == "pending":
            yield self._alarm(key, "dead", failures)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, failures = self.state.get() if self.state.exists() else ("gone", 0)
        if status == "pending":
            yield self._alarm(key, "retry", failures)

    def close(self) -> None:
        pass

    @staticmethod
    def _alarm(key, alarm: str, failures: int) -> pd.DataFrame:
        return pd.DataFrame({"approval_id": [key[0]], "alarm": [alarm], "failures": pd.array([failures], dtype="int32")})


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state in Python needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def retry_alarms(attempts: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, backoff: float = BACKOFF_SECONDS) -> DataFrame:
    """Stream of (approval_id, alarm, failures), alarm being ``retry`` or ``dead``.

    Start it with a processing-time trigger: a run that takes what is there and stops
    (``availableNow``) would wait for its timers for ever."""
    use_rocksdb(attempts.sparkSession)
    return attempts.groupBy("approval_id").transformWithStateInPandas(
        statefulProcessor=RetryAlarms(max_attempts, backoff), outputStructType=ALARM, outputMode="Update", timeMode="ProcessingTime"
    )
