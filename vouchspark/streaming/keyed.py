"""Decisions and alarms in keyed state.

``stream_votes`` first folds every micro-batch over salted, partial aggregates to the votes that may
still count: one per person and approval, and of these no more accepts than an approval needs and
one reject.  ``keyed_status`` then keeps per approval only how many have accepted and who, in state
that ends some time after the approval was settled.

``due_alarms`` runs on event time: the watermark fires the timers, so a run over what is there
ends by itself, and what it says does not hang on how the attempts were cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vouchspark.operators import approvals as A
from vouchspark.operators.scaling import first_rows, salted_join
from vouchspark.streaming.tables import read_table, run_batches, write_batch
from vouchspark.streaming.timers import KEEP_MS, use_rocksdb

VOTE = "approval_id long, decided_by string, decision string, decided_at string, decision_id long, approvers_required int, arrived timestamp"
STATUS = "approval_id long, status string, decided_at string, decided_by string, decision_id long"
DELAY = "1 hour"
ALARM = "approval_id long, alarm string, failures long, due timestamp"


# --- decisions ------------------------------------------------------------------------------
def votes_that_may_count(batch: DataFrame, proposals: DataFrame, most: int) -> DataFrame:
    """Votes of a batch that can settle an approval: the first of every person, of these the first
    ``approvers_required`` accepts and the first reject.  An approval that holds a third of all
    decisions is cut in partial aggregates before any shuffle."""
    well_formed = F.col("decision").isin(*A.WORDS) & (F.coalesce("decided_by", F.lit("")) != "")
    vote = F.min(F.struct("decided_at", "decision_id", "decision")).alias("v")
    per_person = batch.filter(well_formed).groupBy("approval_id", "decided_by").agg(vote).select("approval_id", "decided_by", "v.*")
    order = [F.col("decided_at"), F.col("decision_id")]
    accepts = first_rows(per_person.filter("decision = 'accept'"), ["approval_id"], order, most, "_n").drop("_n")
    rejects = per_person.filter("decision = 'reject'").groupBy("approval_id").agg(F.min(F.struct("decided_at", "decision_id", "decision", "decided_by")).alias("v")).select("approval_id", "v.*")
    known = proposals.select("approval_id", F.col("approvers_required").cast("int").alias("approvers_required"))
    return salted_join(accepts.unionByName(rejects), known, "approval_id", "inner", ["decided_by"])


def stream_votes(decisions: DataFrame, proposals: DataFrame, root: str, *, once: bool = True) -> StreamingQuery:
    """Stream of decisions to the ``votes`` table below ``root``, one folder per batch."""
    most = int(proposals.agg(F.max("approvers_required").alias("m")).first()["m"] or 1)
    columns = [c.split()[0] for c in VOTE.split(", ")]

    def each(batch: DataFrame, number: int) -> None:
        write_batch(votes_that_may_count(batch, proposals, most).withColumn("arrived", F.current_timestamp()).select(*columns), root, "votes", number)

    return run_batches(decisions, each, f"{root}/_progress/votes", once=once)


class Votes(StatefulProcessor):
    """Per approval: who accepted so far, or that it is settled, and when this ends.

    Every call of a state or a timer asks the executor's JVM and waits for it, and so does a look at
    what timers there are.  So an approval has one value, which knows its timer: a settled approval
    costs one call, any other one three, or four where an earlier timer gives way."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("votes", "status string, accepted array<string>, until_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, accepted, until = self.state.get() or (None, [], None)
        if status is not None:
            return
        # At most the accepts an approval needs and one reject for every batch.
        votes, names, settled = sorted(rows, key=_arrival), list(accepted), None
        for vote in votes:
            if vote.decided_by not in names:
                names.append(vote.decided_by)
                if vote.decision == "reject" or vote.approvers_required is not None and len(names) >= vote.approvers_required:
                    settled, status = vote, "rejected" if vote.decision == "reject" else "approved"
                    break
        ends = max(vote.arrived_ms for vote in votes) + self.keep_ms
        if until != ends:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(ends)
        self.state.update((status, [] if settled else names, ends))
        if settled:
            yield Row(approval_id=key[0], status=status, decided_at=settled.decided_at, decided_by=settled.decided_by, decision_id=settled.decision_id)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _arrival(vote: Row) -> tuple:
    """Order of votes: by batch, then by their own time and id; what is NULL comes last."""
    return tuple((vote[name] is None, vote[name] or 0) for name in ("batch", "decided_at", "decision_id"))


def keyed_status(votes: DataFrame, root: str, *, keep_ms: int = KEEP_MS, once: bool = True) -> StreamingQuery:
    """Stream of votes (the ``votes`` table, read with its ``batch``) to the ``settled`` table.

    A vote counts in order of arrival, and arrival is the event time here: nothing is late, and a
    run over what is there ends by itself.  State lasts ``keep_ms`` after the last vote that may
    have counted; proposals are to be decided within that time.  Votes come as rows: a data frame
    for each approval and its few votes takes longer than all that is done with them."""
    use_rocksdb(votes.sparkSession)
    timed = votes.withColumn("arrived_ms", F.unix_millis("arrived")).withWatermark("arrived", DELAY)
    settled = timed.groupBy("approval_id").transformWithState(statefulProcessor=Votes(keep_ms), outputStructType=STATUS, outputMode="Update", timeMode="EventTime")
    each = lambda batch, number: write_batch(batch, root, "settled", number)
    writer = settled.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{root}/_progress/status")
    return (writer.trigger(availableNow=True) if once else writer).start()


def votes_stream(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.schema(VOTE + ", batch long").parquet(f"{root}/votes")


def settled_status(spark: SparkSession, root: str, proposals: DataFrame) -> DataFrame:
    """Proposals with the status reached so far."""
    found = read_table(spark, root, "settled", STATUS).select("approval_id", F.col("status").alias("_status"), "decided_at", "decided_by")
    kept = [c for c in proposals.columns if c not in ("status", "decided_at", "decided_by")]
    return proposals.select(*kept).join(found, "approval_id", "left").select(*kept, F.coalesce("_status", F.lit("pending")).alias("status"), "decided_at", "decided_by")


# --- alarms -----------------------------------------------------------------------------------
class DueAlarms(StatefulProcessor):
    """Per approval: failures so far and when the next try is due."""

    def __init__(self, max_attempts: int, backoff_ms: int, keep_ms: int) -> None:
        self.max_attempts, self.backoff_ms, self.keep_ms = max_attempts, backoff_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("execution", "status string, failures int, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, failures, due = self.state.get() if self.state.exists() else ("pending", 0, None)
        if status != "pending":
            return
        tries, out, now = pd.concat(list(rows)).sort_values(["at_ms", "attempt_id"]), [], 0
        for now, ok in zip(tries["at_ms"].tolist(), tries["ok"].tolist(), strict=True):
            if due is not None and due < now:
                out.append((key[0], "retry", failures, due))
            failures += not ok
            status = "succeeded" if ok else "dead" if failures >= self.max_attempts else "pending"
            if status != "pending":
                break
            due = now + self.backoff_ms
        if status == "dead":
            out.append((key[0], "dead", failures, now))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A settled approval is remembered for a while, so that a late attempt stays silent.
        self.state.update((status, failures, due if status == "pending" else None))
        self.handle.registerTimer(due if status == "pending" else now + self.keep_ms)
        if out:
            yield _alarms(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, failures, due = self.state.get()
        if status != "pending":
            self.state.clear()
        elif due is not None and expiredTimerInfo.getExpiryTimeInMs() >= due:
            self.state.update((status, failures, None))
            yield _alarms([(key[0], "retry", failures, due)])

    def close(self) -> None:
        pass


def _alarms(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["approval_id", "alarm", "failures", "due_ms"])


def due_alarms(
    attempts: DataFrame, *, max_attempts: int = A.MAX_ATTEMPTS, backoff: float = A.BACKOFF_SECONDS, delay: str = DELAY, keep_ms: int = KEEP_MS
) -> DataFrame:
    """Stream of (approval_id, alarm, failures, due) from attempts (attempt_id, approval_id, ok, at_time).

    ``retry``: ``backoff`` seconds after a failure no other attempt had come.  ``dead``: the last allowed
    failure.  Alarms are told once the watermark, ``delay`` behind the latest attempt, has passed them;
    attempts may come late by that much.  State of a settled approval ends ``keep_ms`` later."""
    use_rocksdb(attempts.sparkSession)
    when = F.col("at_time").cast("timestamp")
    timed = attempts.select("approval_id", "attempt_id", "ok", when.alias("at_time"), F.unix_millis(when).alias("at_ms")).withWatermark("at_time", delay)
    found = timed.groupBy("approval_id").transformWithStateInPandas(
        statefulProcessor=DueAlarms(max_attempts, int(backoff * 1000), keep_ms), outputStructType="approval_id long, alarm string, failures long, due_ms long",
        outputMode="Update", timeMode="EventTime",
    )
    return found.select("approval_id", "alarm", "failures", F.timestamp_millis("due_ms").alias("due"))


def stream_alarms(attempts: DataFrame, root: str, *, once: bool = True, **options) -> StreamingQuery:
    """Run ``due_alarms`` into the ``alarms`` table below ``root``."""
    each = lambda batch, number: write_batch(batch, root, "alarms", number)
    writer = due_alarms(attempts, **options).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{root}/_progress/alarms")
    return (writer.trigger(availableNow=True) if once else writer).start()


def alarm_table(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "alarms", ALARM)
