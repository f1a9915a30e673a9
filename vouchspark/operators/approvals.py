"""Approvals: intake, decision folds, policy checks, execution folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchspark import schemas
from vouchspark.operators.scaling import first_rows, salted_join

WORDS = ("accept", "reject")
MAX_ATTEMPTS, BACKOFF_SECONDS = 3, 30


def intake(proposals: DataFrame) -> DataFrame:
    """Proposals that may be queued, as pending approvals: at least one approver needed."""
    required = F.coalesce("approvers_required", F.lit(1))
    return proposals.withColumn("approvers_required", required).filter(required >= 1).withColumn("status", F.lit("pending"))


# --- decisions ---------------------------------------------------------------------------------
def _votes(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """The first valid decision of each person on each known approval.

    Reduced to one row per (approval, person) by a partial aggregate; a later vote of the
    same person never counts."""
    known = proposals.select("approval_id", "approvers_required")
    well_formed = F.col("decision").isin(*WORDS) & (F.coalesce("decided_by", F.lit("")) != "")
    fields = [c for c in ("decided_at", "decision_id", "decision", "note") if c in decisions.columns]
    first = F.min(F.struct(*fields)).alias("v")
    per_person = decisions.filter(well_formed).groupBy("approval_id", "decided_by").agg(first)
    joined = salted_join(per_person, known, "approval_id", "inner", ["decided_by"])
    return joined.select("approval_id", "decided_by", "approvers_required", "v.*")


def flipping_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decision that settles each settled approval: the first reject, or the accept
    that completes the required number, whichever comes first.

    Runs one job for the largest number of approvers.  With that number fixed, only so many
    accepts per approval leave any task, and the first reject is a partial minimum, so an
    approval that holds a third of all decisions is cut down before the shuffle.
    """
    votes = _votes(proposals, decisions)
    most = proposals.agg(F.max("approvers_required").alias("m")).first()["m"] or 1
    order = [F.col("decided_at"), F.col("decision_id")]
    accepts = first_rows(votes.filter(F.col("decision") == "accept"), ["approval_id"], order, int(most), "_n")
    completing = accepts.filter(F.col("_n") == F.col("approvers_required")).drop("_n")
    rejects = votes.filter(F.col("decision") == "reject")
    vote = F.struct("decided_at", "decision_id", "decision", "decided_by", "note")
    settled = completing.unionByName(rejects).groupBy("approval_id").agg(F.min(vote).alias("v"))
    status = F.when(F.col("v.decision") == "reject", "rejected").otherwise("approved")
    return settled.select("approval_id", status.alias("new_status"), "v.decided_at", "v.decision_id", "v.decided_by", "v.note")


def fold_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with status, decided_at, decided_by and decision_note."""
    settled = flipping_decisions(proposals, decisions).select(
        "approval_id", "new_status", "decided_at", "decided_by", F.col("note").alias("decision_note")
    )
    kept = [c for c in proposals.columns if c not in ("status", "decided_at", "decided_by", "decision_note")]
    return proposals.select(*kept).join(settled, "approval_id", "left").select(
        *kept, F.coalesce("new_status", F.lit("pending")).alias("status"), "decided_at", "decided_by", "decision_note"
    )


def judged_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every decision with ``error`` (NULL if it was recorded).  Faults in order: bad word,
    nobody named, unknown approval, already decided, second vote of a person."""
    settled = flipping_decisions(proposals, decisions).select(
        "approval_id", F.struct("decided_at", "decision_id").alias("flip")
    )
    first = _votes(proposals, decisions).select(
        "approval_id", "decided_by", F.col("decision_id").alias("first_id")
    )
    known = proposals.select("approval_id", F.lit(True).alias("known")).join(settled, "approval_id", "left")
    joined = salted_join(decisions, known, "approval_id", "left", ["decision_id"]).join(first, ["approval_id", "decided_by"], "left")
    error = (
        F.when(~F.coalesce(F.col("decision").isin(*WORDS), F.lit(False)), "invalid decision")
        .when(F.coalesce("decided_by", F.lit("")) == "", "decided_by required")
        .when(F.col("known").isNull(), "unknown approval")
        .when(F.struct("decided_at", "decision_id") > F.col("flip"), "already decided")
        .when(F.col("decision_id") != F.col("first_id"), "duplicate approver")
    )
    return joined.withColumn("error", error).select(*decisions.columns, "error")


def decision_errors(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    return judged_decisions(proposals, decisions).filter(F.col("error").isNotNull())


def recorded_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    return judged_decisions(proposals, decisions).filter(F.col("error").isNull()).drop("error")


def progress(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Accept and reject counts, ``accepts/required`` and the decisions by time.

    Only recorded decisions count, and an approval takes no more once it is settled, so its
    list is no longer than the approvers it needs (and one reject)."""
    recorded = recorded_decisions(proposals, decisions)
    listed = F.array_sort(F.collect_list(F.struct("decided_at", "decision_id", "decision", "decided_by")))
    tally = recorded.groupBy("approval_id").agg(
        F.count_if(F.col("decision") == "accept").alias("accept_count"),
        F.count_if(F.col("decision") == "reject").alias("reject_count"), listed.alias("decisions"),
    )
    empty = F.array().cast(tally.schema["decisions"].dataType)
    joined = proposals.select("approval_id", "approvers_required").join(tally, "approval_id", "left")
    accepts = F.coalesce("accept_count", F.lit(0))
    return joined.select(
        "approval_id", accepts.alias("accept_count"), F.coalesce("reject_count", F.lit(0)).alias("reject_count"),
        F.concat_ws("/", accepts.cast("string"), F.col("approvers_required").cast("string")).alias("progress"),
        F.coalesce("decisions", empty).alias("decisions"),
    )


def list_approvals(approvals: DataFrame, status: str | None = "pending", limit: int = 50) -> DataFrame:
    """Newest first, ties by id; an unknown status is refused."""
    if status is not None:
        if status not in schemas.APPROVAL_STATUSES:
            raise ValueError(f"invalid status filter: {status!r}")
        approvals = approvals.filter(F.col("status") == status)
    return approvals.orderBy(F.col("created_at").desc(), F.col("approval_id").asc()).limit(limit)


# --- policy --------------------------------------------------------------------------------------
def allowed(proposals: DataFrame, allow: DataFrame, *, refused: bool = False) -> DataFrame:
    """Proposals whose (workspace, executor) is on the list; everything else is denied."""
    return proposals.join(allow.select("workspace", "executor").distinct(), ["workspace", "executor"], "left_anti" if refused else "left_semi")


# JSON types by the name Spark gives the type of a parsed value.
TYPE_PATTERNS = {
    "object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "boolean": "^BOOLEAN",
    "integer": "^(BIGINT|DECIMAL[(][0-9]+,0[)])$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)",
}


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def violations(value: Column, spec: dict, path: str = "params") -> Column:
    """Faults of a parsed JSON value against a field table: type, required fields, extra
    fields, nested objects and array items.  A boolean is never a number."""
    expected = spec.get("type")
    none = F.array().cast("array<string>")
    faults = none
    if expected == "object":
        keys = F.coalesce(F.json_object_keys(F.to_json(value)), none)
        fields = spec.get("properties", {})
        lacking = F.array_except(F.array(*[F.lit(r) for r in spec.get("required", [])]).cast("array<string>"), keys)
        faults = F.transform(lacking, lambda k: F.concat(F.lit(f"{path}: missing required field "), k))
        if spec.get("additionalProperties") is False:
            extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in fields]).cast("array<string>")))
            faults = F.concat(faults, F.transform(extra, lambda k: F.concat(F.lit(f"{path}: unexpected property "), k)))
        for name, inner in fields.items():
            member = F.try_variant_get(value, f"$['{name}']", "variant")
            inside = F.when(F.array_contains(keys, name), violations(member, inner, f"{path}.{name}")).otherwise(none)
            faults = F.concat(faults, inside)
    elif expected == "array" and spec.get("items"):
        items = F.try_variant_get(value, "$", "array<variant>")
        found = F.flatten(F.transform(items, lambda item: violations(item, spec["items"], f"{path}[*]")))
        faults = F.coalesce(found, none)
    if expected is None:
        return faults
    fits = F.rlike(_kind(value), F.lit(TYPE_PATTERNS[expected]))
    wrong = F.array(F.concat(F.lit(f"{path}: expected {expected}, got "), F.lower(F.regexp_extract(_kind(value), "^[A-Z]+", 0))))
    return F.when(F.coalesce(fits, F.lit(False)), faults).otherwise(wrong)


def validate_params(proposals: DataFrame, fields: dict[str, dict], params: str = "params") -> DataFrame:
    """``violations`` per proposal against its executor's field table; empty means valid."""
    value = F.try_parse_json(params)
    found = F.array(F.concat(F.lit("unknown executor: "), F.col("executor")))
    for executor, spec in fields.items():
        found = F.when(F.col("executor") == executor, violations(F.col("_value"), spec)).otherwise(found)
    checked = F.when(F.col("_value").isNull(), F.array(F.lit("params: not JSON"))).otherwise(found)
    return proposals.withColumn("_value", value).withColumn("violations", checked).drop("_value")


# --- executions -------------------------------------------------------------------------------------
def with_keys(approvals: DataFrame) -> DataFrame:
    return approvals.withColumn("key", F.coalesce("idempotency_key", F.col("approval_id").cast("string")))


def dedupe_keys(approvals: DataFrame) -> DataFrame:
    """``owns_key``: a key belongs to the first approval that takes it, by creation time.
    The owner is a partial minimum per key, matched back by key and id."""
    keyed = with_keys(approvals)
    owner = keyed.groupBy("key").agg(F.min(F.struct("created_at", "approval_id")).alias("o")).select(
        "key", F.col("o.approval_id").alias("approval_id"), F.lit(True).alias("_owner")
    )
    return keyed.join(owner, ["key", "approval_id"], "left").withColumn("owns_key", F.coalesce("_owner", F.lit(False))).drop("_owner")


def leasable(approvals: DataFrame, executions: DataFrame, at: str) -> DataFrame:
    """Approved actions that may be taken at time ``at``: never tried, waiting with the
    retry due, or leased to someone whose lease ran out before ``at``.  Combine with
    ``dedupe_keys`` to leave out approvals whose key belongs to another one."""
    ready = approvals.filter((F.col("status") == "approved") & F.col("has_action"))
    joined = ready.join(executions.select("approval_id", "exec_status", "next_retry_at", "lease_expires_at"), "approval_id", "left")
    free = (
        F.col("exec_status").isNull()
        | ((F.col("exec_status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= at)))
        | ((F.col("exec_status") == "leased") & (F.col("lease_expires_at") < at))
    )
    return joined.filter(free).orderBy("created_at", "approval_id")


def effective_attempts(attempts: DataFrame, *, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The attempts that count: failures before the first success, up to ``max_attempts``,
    and that success unless the action was dead by then.

    Failures are cut to ``max_attempts`` per approval before the shuffle and the first
    success is a partial minimum, so an approval with very many attempts is no burden.
    """
    columns = attempts.columns
    others = [c for c in columns if c not in ("approval_id", "at", "attempt_id")]
    wins = attempts.filter("ok").groupBy("approval_id").agg(F.min(F.struct("at", "attempt_id", *others)).alias("w"))
    order = [F.col("at"), F.col("attempt_id")]
    losses = first_rows(attempts.filter(~F.col("ok")), ["approval_id"], order, max_attempts, "_n")
    earlier = losses.join(wins, "approval_id", "left").filter(
        F.col("w").isNull() | (F.struct("at", "attempt_id") < F.struct("w.at", "w.attempt_id"))
    )
    dead = earlier.filter(F.col("_n") == max_attempts).select("approval_id")
    kept_wins = wins.join(dead, "approval_id", "left_anti").select("approval_id", "w.*")
    return earlier.select(*columns).unionByName(kept_wins.select(*columns))


def fold_attempts(attempts: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, backoff: int = BACKOFF_SECONDS) -> DataFrame:
    """Execution row per approval from its attempts (approval_id, attempt_id, ok, at, at_time).

    Success and the last allowed failure are terminal; before that a failure waits
    ``backoff`` seconds.
    """
    counted = effective_attempts(attempts, max_attempts=max_attempts)
    tally = counted.groupBy("approval_id").agg(
        F.count_if(~F.col("ok")).alias("attempts"), F.max(F.when(~F.col("ok"), F.col("at_time"))).alias("last_failure"),
        F.min(F.when(F.col("ok"), F.col("at"))).alias("won"),
    )
    status = F.when(F.col("attempts") >= max_attempts, "dead").when(F.col("won").isNotNull(), "succeeded").otherwise("pending")
    retry = F.date_format(F.col("last_failure") + F.make_interval(secs=F.lit(backoff)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return tally.withColumn("exec_status", status).select(
        "approval_id", "exec_status", "attempts", F.col("won").alias("executed_at"),
        F.when(F.col("exec_status") == "pending", retry).alias("next_retry_at"),
    )


def drain_summary(attempts: DataFrame, by: str = "pass") -> DataFrame:
    """Succeeded and failed attempts per pass."""
    return attempts.groupBy(by).agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
