"""Queries over approvals and executions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchspark.operators import approvals as A
from vouchspark.plans import derived as D
from vouchspark.plans.registry import query


@query("SELECT approval_id, workspace, approvers_required, 'pending' AS status, created_at FROM proposals WHERE approval_id % 5 <> 0")
def queued_proposals(spark, sf):
    """A1: proposals that may be queued."""
    asked = D.proposals(spark, sf)
    needed = F.when(F.col("approval_id") % 5 == 0, 0).otherwise(F.col("approvers_required"))
    return A.intake(asked.withColumn("approvers_required", needed)).select("approval_id", "workspace", "approvers_required", "status", "created_at")


@query("SELECT approval_id, status, decided_at, decided_by, decision_note FROM folded")
def decided_approvals(spark, sf):
    """A2: status of every proposal after all decisions."""
    found = A.fold_decisions(*D.proposals_and_decisions(spark, sf))
    return found.select("approval_id", "status", "decided_at", "decided_by", "decision_note")


@query("""
    SELECT d.decision_id, CASE WHEN d.decision = 'maybe' THEN 'invalid decision' WHEN d.decided_by IS NULL THEN 'decided_by required'
             WHEN d.approvers_required IS NULL THEN 'unknown approval'
             WHEN (d.decided_at, d.decision_id) > (t.decided_at, t.decision_id) THEN 'already decided'
             WHEN d.decision_id <> f.decision_id THEN 'duplicate approver' END AS error
    FROM decisions d LEFT JOIN terminal t ON t.approval_id = d.approval_id LEFT JOIN first_votes f ON f.approval_id = d.approval_id AND f.decided_by = d.decided_by""")
def judged_decisions(spark, sf):
    """A3: decisions that were recorded, and why the others were not."""
    return A.judged_decisions(*D.proposals_and_decisions(spark, sf)).select("decision_id", "error")


@query("SELECT approval_id, created_at FROM folded WHERE status = 'approved' ORDER BY created_at DESC, approval_id LIMIT 50")
def newest_approved(spark, sf):
    """A4: newest approved proposals."""
    return A.list_approvals(A.fold_decisions(*D.proposals_and_decisions(spark, sf)), "approved").select("approval_id", "created_at")


@query("""
    WITH r AS (SELECT f.* FROM first_votes f LEFT JOIN terminal t ON t.approval_id = f.approval_id WHERE t.decision_id IS NULL OR (f.decided_at, f.decision_id) <= (t.decided_at, t.decision_id)),
    g AS (SELECT approval_id, count(*) FILTER (decision = 'accept') AS a, count(*) FILTER (decision = 'reject') AS r, string_agg(decided_by || ':' || decision, ',' ORDER BY decided_at, decision_id) AS l FROM r GROUP BY 1)
    SELECT p.approval_id, coalesce(a, 0) AS accept_count, coalesce(r, 0) AS reject_count, coalesce(a, 0) || '/' || p.approvers_required AS progress, coalesce(l, '') AS votes
    FROM proposals p LEFT JOIN g ON g.approval_id = p.approval_id""")
def approval_progress(spark, sf):
    """A5: votes so far."""
    found = A.progress(*D.proposals_and_decisions(spark, sf))
    votes = F.array_join(F.transform("decisions", lambda d: F.concat_ws(":", d["decided_by"], d["decision"])), ",")
    return found.select("approval_id", "accept_count", "reject_count", "progress", votes.alias("votes"))


ALLOWED_SQL = "(executor = 'fs.write_file' OR (executor = 'mail.send' AND workspace IN ('ws1', 'ws2')))"


@query(f"SELECT approval_id, {ALLOWED_SQL} AS may_run FROM proposals")
def allow_list(spark, sf):
    """Proposals on the allow-list; the rest is denied."""
    asked = D.proposals(spark, sf)
    allow = asked.filter((F.col("executor") == "fs.write_file") | ((F.col("executor") == "mail.send") & F.col("workspace").isin("ws1", "ws2")))
    allow = allow.select("workspace", "executor").distinct()
    yes, no = A.allowed(asked, allow), A.allowed(asked, allow, refused=True)
    return yes.select("approval_id", F.lit(True).alias("may_run")).unionByName(no.select("approval_id", F.lit(False).alias("may_run")))


FIELDS = {
    "type": "object", "required": ["path", "content"], "additionalProperties": False,
    "properties": {"path": {"type": "string"}, "content": {"type": "string"}, "retries": {"type": "integer"}},
}


@query("""
    SELECT approval_id, CASE WHEN approval_id % 11 = 0 THEN (CASE WHEN x THEN 'unknown executor: shell.run' ELSE 'params.path: expected string, got bigint' END)
         WHEN approval_id % 13 = 0 THEN (CASE WHEN x THEN 'unknown executor: shell.run' ELSE 'params: missing required field path' END)
         WHEN approval_id % 17 = 0 THEN (CASE WHEN x THEN 'unknown executor: shell.run' ELSE 'params: unexpected property mode' END)
         WHEN approval_id % 19 = 0 THEN (CASE WHEN x THEN 'unknown executor: shell.run' ELSE 'params.retries: expected integer, got boolean' END)
         WHEN approval_id % 23 = 0 THEN 'params: not JSON' WHEN x THEN 'unknown executor: shell.run' ELSE '' END AS violations
    FROM (SELECT approval_id, executor = 'shell.run' AS x FROM proposals)""")
def parameter_checks(spark, sf):
    """Action parameters against the executor's field table."""
    found = A.validate_params(D.proposals(spark, sf), {"fs.write_file": FIELDS, "mail.send": FIELDS})
    return found.select("approval_id", F.array_join("violations", "; ").alias("violations"))


EXEC_SQL = """
    x AS (SELECT approval_id, CASE approval_id % 6 WHEN 1 THEN 'pending' WHEN 2 THEN 'pending' WHEN 3 THEN 'leased' WHEN 4 THEN 'succeeded' ELSE 'dead' END AS exec_status,
          CASE WHEN approval_id % 6 = 2 THEN '2024-01-' || lpad(CAST(approval_id % 28 + 1 AS VARCHAR), 2, '0') END AS next_retry_at,
          CASE WHEN approval_id % 6 = 3 THEN '2024-01-' || lpad(CAST(approval_id % 28 + 1 AS VARCHAR), 2, '0') END AS lease_expires_at FROM proposals WHERE approval_id % 6 > 0)"""


@query(f"""
    WITH {EXEC_SQL} SELECT f.approval_id, f.created_at FROM folded f LEFT JOIN x ON x.approval_id = f.approval_id
    WHERE f.status = 'approved' AND f.has_action AND (x.exec_status IS NULL OR (x.exec_status = 'pending' AND (x.next_retry_at IS NULL OR x.next_retry_at <= '2024-01-15'))
       OR (x.exec_status = 'leased' AND x.lease_expires_at < '2024-01-15'))""")
def leasable_actions(spark, sf):
    """Approved actions that may be taken now."""
    asked, made = D.proposals_and_decisions(spark, sf)
    aid = F.col("approval_id")
    day = F.concat(F.lit("2024-01-"), F.lpad((aid % 28 + 1).cast("string"), 2, "0"))
    state = F.when((aid % 6).isin(1, 2), "pending").when(aid % 6 == 3, "leased").when(aid % 6 == 4, "succeeded").otherwise("dead")
    executions = asked.filter(aid % 6 > 0).select(
        "approval_id", state.alias("exec_status"), F.when(aid % 6 == 2, day).alias("next_retry_at"), F.when(aid % 6 == 3, day).alias("lease_expires_at")
    )
    return A.leasable(A.fold_decisions(asked, made), executions, "2024-01-15").select("approval_id", "created_at")


@query("""
    SELECT approval_id, key, row_number() OVER (PARTITION BY key ORDER BY created_at, approval_id) = 1 AS owns_key FROM keyed""")
def idempotency_keys(spark, sf):
    """Who owns each key."""
    return A.dedupe_keys(D.proposals(spark, sf)).select("approval_id", "key", "owns_key")


FOLD_SQL = """
    win AS (SELECT * FROM attempts WHERE ok QUALIFY row_number() OVER (PARTITION BY approval_id ORDER BY tried, attempt_id) = 1),
    lost AS (SELECT a.approval_id, a.at_time, row_number() OVER (PARTITION BY a.approval_id ORDER BY a.tried, a.attempt_id) AS n FROM attempts a LEFT JOIN win w ON w.approval_id = a.approval_id
             WHERE NOT a.ok AND (w.tried IS NULL OR (a.tried, a.attempt_id) < (w.tried, w.attempt_id))),
    f AS (SELECT approval_id, count(*) AS attempts, max(at_time) AS last FROM lost WHERE n <= 3 GROUP BY 1),
    e AS (SELECT i.approval_id, coalesce(f.attempts, 0) AS attempts, f.last, w.tried AS won, CASE WHEN f.attempts >= 3 THEN 'dead' WHEN w.tried IS NOT NULL THEN 'succeeded' ELSE 'pending' END AS exec_status
          FROM (SELECT DISTINCT approval_id FROM attempts) i LEFT JOIN f ON f.approval_id = i.approval_id LEFT JOIN win w ON w.approval_id = i.approval_id)"""


def _attempts(spark, sf):
    return D.attempts(spark, sf).join(D.proposals(spark, sf).select("idx", "approval_id"), "idx").drop("idx")


@query(f"""
    WITH {FOLD_SQL} SELECT approval_id, exec_status, attempts, CASE WHEN exec_status = 'succeeded' THEN won END AS executed_at,
      CASE WHEN exec_status = 'pending' THEN strftime(last + INTERVAL 30 SECOND, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS next_retry_at FROM e""")
def folded_attempts(spark, sf):
    """A10: execution state after all attempts."""
    return A.fold_attempts(_attempts(spark, sf))


@query("SELECT substr(tried, 1, 10) AS pass, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed FROM attempts GROUP BY 1")
def drained_per_pass(spark, sf):
    """Good and failed attempts per pass (here: per day)."""
    return A.drain_summary(_attempts(spark, sf).withColumn("pass", F.substring("at", 1, 10)))
