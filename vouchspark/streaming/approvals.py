"""Decision and attempt streams.

What counts is bounded by the rules: a settled approval records no more votes, and an
execution keeps at most its allowed failures and one success.  So the state is a small
table of recorded events; each micro-batch joins the part it touches and runs the same
skew-safe folds as the batch job, ordered by arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vouchspark.operators import approvals as A
from vouchspark.operators.scaling import unsent
from vouchspark.streaming.tables import arrival_order, own_time, read_table, run_batches, write_batch

DECISION = "decision_id long, approval_id long, decision string, decided_by string, decided_at string, note string"
ATTEMPT = "attempt_id long, approval_id long, ok boolean, at string, at_time timestamp"


def decision_batch(batch: DataFrame, number: int, root: str, proposals: DataFrame) -> None:
    columns = [c.split()[0] for c in DECISION.split(", ")]
    touched = unsent(batch.select("approval_id").distinct())
    held = read_table(batch.sparkSession, root, "recorded", DECISION, before=number).join(touched, "approval_id", "left_semi")
    before = held.withColumn("decided_at", arrival_order(None, "decided_at")).select(*columns, F.lit(False).alias("is_new"))
    now = batch.withColumn("decided_at", arrival_order(number, "decided_at")).select(*columns, F.lit(True).alias("is_new"))
    concerned = proposals.join(touched, "approval_id", "left_semi")
    judged = A.judged_decisions(concerned, before.unionByName(now)).filter("is_new").withColumn("decided_at", own_time("decided_at"))
    write_batch(judged.select(*columns, "error"), root, "judged", number)
    done = batch.sparkSession.read.parquet(f"{root}/judged/batch={number}")
    write_batch(done.filter(F.col("error").isNull()).drop("error"), root, "recorded", number)
    write_batch(done.filter(F.col("error").isNotNull()), root, "errors", number)


def stream_decisions(decisions: DataFrame, proposals: DataFrame, root: str, *, once: bool = True) -> StreamingQuery:
    """Stream of decisions: accepted ones go to ``recorded``, all others to ``errors``.

    A decision counts in order of arrival; one that comes after its approval was settled is
    an error even if its own time is earlier."""
    each = lambda batch, number: decision_batch(batch, number, root, proposals)
    return run_batches(decisions, each, f"{root}/_progress/decisions", once=once)


def approval_status(spark: SparkSession, root: str, proposals: DataFrame) -> DataFrame:
    """Proposals with the status reached so far."""
    recorded = read_table(spark, root, "recorded", DECISION)
    ordered = recorded.withColumn("decided_at", arrival_order(None, "decided_at"))
    return A.fold_decisions(proposals, ordered).withColumn("decided_at", own_time("decided_at"))


def decision_faults(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "errors", DECISION + ", error string")


def attempt_batch(batch: DataFrame, number: int, root: str, max_attempts: int, backoff: int) -> None:
    columns = [c.split()[0] for c in ATTEMPT.split(", ")]
    touched = batch.select("approval_id").distinct()
    held = read_table(batch.sparkSession, root, "attempts", ATTEMPT, before=number).join(touched, "approval_id", "left_semi")
    before = held.withColumn("at", arrival_order(None, "at")).select(*columns, F.lit(False).alias("is_new"))
    now = batch.withColumn("at", arrival_order(number, "at")).select(*columns, F.lit(True).alias("is_new"))
    counted = A.effective_attempts(before.unionByName(now), max_attempts=max_attempts)
    write_batch(counted.filter("is_new").drop("is_new").withColumn("at", own_time("at")), root, "attempts", number)
    dead = A.fold_attempts(counted, max_attempts=max_attempts, backoff=backoff).filter(F.col("exec_status") == "dead")
    already = A.fold_attempts(before, max_attempts=max_attempts, backoff=backoff).filter(F.col("exec_status") == "dead")
    write_batch(dead.join(already.select("approval_id"), "approval_id", "left_anti").select("approval_id", "attempts"), root, "dead_letters", number)


def stream_attempts(
    attempts: DataFrame, root: str, *, max_attempts: int = A.MAX_ATTEMPTS, backoff: int = A.BACKOFF_SECONDS, once: bool = True
) -> StreamingQuery:
    """Stream of execution attempts.  Attempts after a success or the last allowed failure do
    not count; an approval that just used up its attempts goes to ``dead_letters``."""
    each = lambda batch, number: attempt_batch(batch, number, root, max_attempts, backoff)
    return run_batches(attempts, each, f"{root}/_progress/attempts", once=once)


def execution_status(spark: SparkSession, root: str, **options) -> DataFrame:
    """Execution row per approval so far, with the time of its next retry."""
    counted = read_table(spark, root, "attempts", ATTEMPT).withColumn("at", arrival_order(None, "at"))
    return A.fold_attempts(counted, **options).withColumn("executed_at", own_time("executed_at"))


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "dead_letters", "approval_id long, attempts long")
