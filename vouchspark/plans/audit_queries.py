"""Queries over audit tables and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchspark.operators import audit as U
from vouchspark.operators.scaling import global_positions
from vouchspark.plans import derived as D
from vouchspark.plans.registry import query
from vouchspark.session import stored


def _approvals(spark, sf):
    asked, made = D.proposals_and_decisions(spark, sf)
    return asked, made


@query("""
    SELECT 'approval' AS row_kind, CAST(approval_id AS VARCHAR) AS approval_id, workspace, CAST(approvers_required AS VARCHAR) AS approvers_required, created_at, '' AS decision_id, '' AS decision, '' AS decided_by, '' AS decided_at_decision, '' AS note FROM proposals
    UNION ALL SELECT 'decision', CAST(approval_id AS VARCHAR), '', '', '', CAST(decision_id AS VARCHAR), decision, coalesce(decided_by, ''), decided_at, note FROM decisions""")
def approval_rows(spark, sf):
    """Approvals and decisions as one stream."""
    found = U.flatten(*_approvals(spark, sf))
    return found.select("row_kind", "approval_id", "workspace", "approvers_required", "created_at", "decision_id", "decision", "decided_by", "decided_at_decision", "note")


@query("""
    SELECT row_kind, id, row_number() OVER (ORDER BY row_kind, moment, id) AS place FROM (
      SELECT 'approval' AS row_kind, approval_id AS id, created_at AS moment FROM proposals UNION ALL SELECT 'decision', decision_id, decided_at FROM decisions)""")
def approval_order(spark, sf):
    """The order of that stream, all approvals first."""
    found = U.flatten(*_approvals(spark, sf))
    placed = global_positions(found, ["order_key"], "place")
    return placed.select("row_kind", F.when(F.col("row_kind") == "approval", F.col("approval_id")).otherwise(F.col("decision_id")).cast("long").alias("id"), "place")


def _held_traces(spark, sf):
    return D.traces(spark, sf).filter(F.col("run_id") % 13 != 0)


@query("SELECT run_id FROM runs WHERE run_id % 13 = 0")
def runs_without_trace(spark, sf):
    """Runs whose trace is missing."""
    return U.missing_traces(D.runs(spark, sf), _held_traces(spark, sf))


@query("SELECT evidence_id, source_path AS path FROM ev WHERE doc_id % 50 = 0")
def evidence_without_file(spark, sf):
    """U4: evidence whose stored file is gone."""
    return U.missing_files(D.unversioned(spark, sf), D.files(spark, sf)).select("evidence_id", "path")


@query("""
    SELECT 'runs' AS fact, CAST((SELECT count(*) FROM runs) AS VARCHAR) AS value UNION ALL SELECT 'evidence', CAST((SELECT count(*) FROM ev) AS VARCHAR)
    UNION ALL SELECT 'approvals', CAST((SELECT count(*) FROM proposals) AS VARCHAR) UNION ALL SELECT 'approval_decisions', CAST((SELECT count(*) FROM decisions) AS VARCHAR)
    UNION ALL SELECT 'trace_files', CAST((SELECT count(*) FROM runs WHERE run_id % 13 <> 0) AS VARCHAR) UNION ALL SELECT 'trace_schema_versions_seen', '1,2,3'""")
def bundle_facts(spark, sf):
    """Counts and versions of an export."""
    asked, made = _approvals(spark, sf)
    held = _held_traces(spark, sf)
    tables = {"runs": D.runs(spark, sf), "evidence": D.unversioned(spark, sf), "approvals": asked, "approval_decisions": made, "trace_files": held}
    return U.bundle_stats(tables, held)


def _outcomes(checked):
    return checked.select("item", "outcome")


@query("SELECT source_path AS item, CASE WHEN doc_id % 50 = 0 OR doc_id % 60 = 1 THEN 'failed' ELSE 'passed' END AS outcome FROM ev")
def invariant_hashes(spark, sf):
    """Recorded hashes against the files."""
    listed = D.unversioned(spark, sf).select(F.col("source_path").alias("path"), "sha256")
    return _outcomes(U.check_i1(listed, D.files(spark, sf)))


@query("SELECT CAST(run_id AS VARCHAR) AS item, CASE WHEN run_id % 13 = 0 THEN 'failed' ELSE 'passed' END AS outcome FROM runs")
def invariant_traces(spark, sf):
    """Every run has a trace."""
    return _outcomes(U.check_i2(D.runs(spark, sf), _held_traces(spark, sf)))


KNOWN_SQL = "(SELECT 'e' || doc_id FROM ev WHERE doc_id < 690)"


def _known_evidence(evidence):
    return evidence.filter(F.col("doc_id") < 690).select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("evidence_id"))


@query(f"SELECT CAST(run_id AS VARCHAR) AS item, CASE WHEN evidence_id IN {KNOWN_SQL} THEN 'passed' ELSE 'failed' END AS outcome FROM returned")
def invariant_chunks(spark, sf):
    """U8: retrieved chunks point at known evidence."""
    return _outcomes(U.check_i3(D.traces(spark, sf), _known_evidence(D.unversioned(spark, sf))))


@query("SELECT evidence_id AS item, CASE WHEN doc_id % 50 = 0 THEN 'skipped' WHEN doc_id % 60 = 1 THEN 'failed' ELSE 'passed' END AS outcome FROM ev")
def invariant_sources(spark, sf):
    """Evidence against its source where that is still there."""
    return _outcomes(U.check_i4(D.unversioned(spark, sf), D.files(spark, sf)))


@query("SELECT CAST(run_id AS VARCHAR) AS item, CASE WHEN run_id % 4 = 3 THEN 'failed' ELSE 'passed' END AS outcome FROM runs")
def invariant_versions(spark, sf):
    """Supported trace versions."""
    return _outcomes(U.check_i5(D.traces(spark, sf)))


@query("""
    SELECT 'approval ' || approval_id AS item, CASE WHEN source_run_id IN (SELECT run_id FROM runs) THEN 'passed' ELSE 'failed' END AS outcome FROM proposals
    UNION ALL SELECT 'decision ' || decision_id, CASE WHEN approvers_required IS NOT NULL THEN 'passed' ELSE 'failed' END FROM decisions""")
def invariant_approvals(spark, sf):
    """Approvals name known runs, decisions known approvals."""
    return _outcomes(U.check_i6(*_approvals(spark, sf), D.runs(spark, sf)))


def _all_checks(spark, sf):
    """The checks run as one job, so what several of them read is derived once and stored."""
    evidence = stored(D.unversioned(spark, sf).select("evidence_id", "sha256", "doc_id", "source_path"))
    traces = stored(_held_traces(spark, sf).select("run_id", "schema_version", "retrieval"))
    files, runs = stored(D.files(spark, sf)), D.runs(spark, sf)
    listed = evidence.select(F.col("source_path").alias("path"), "sha256")
    return [
        U.check_i1(listed, files), U.check_i2(runs, traces), U.check_i3(traces, _known_evidence(evidence)),
        U.check_i4(evidence, files), U.check_i5(traces), U.check_i6(*_approvals(spark, sf), runs),
    ]


@query(f"""
    WITH o AS (SELECT 'I1' AS invariant, CASE WHEN doc_id % 50 = 0 OR doc_id % 60 = 1 THEN 'failed' ELSE 'passed' END AS outcome FROM ev
      UNION ALL SELECT 'I2', CASE WHEN run_id % 13 = 0 THEN 'failed' ELSE 'passed' END FROM runs
      UNION ALL SELECT 'I3', CASE WHEN evidence_id IN {KNOWN_SQL} THEN 'passed' ELSE 'failed' END FROM returned WHERE run_id % 13 <> 0
      UNION ALL SELECT 'I4', CASE WHEN doc_id % 50 = 0 THEN 'skipped' WHEN doc_id % 60 = 1 THEN 'failed' ELSE 'passed' END FROM ev
      UNION ALL SELECT 'I5', CASE WHEN run_id % 4 = 3 THEN 'failed' ELSE 'passed' END FROM runs WHERE run_id % 13 <> 0
      UNION ALL SELECT 'I6', CASE WHEN source_run_id IN (SELECT run_id FROM runs) THEN 'passed' ELSE 'failed' END FROM proposals
      UNION ALL SELECT 'I6', CASE WHEN approvers_required IS NOT NULL THEN 'passed' ELSE 'failed' END FROM decisions)
    SELECT invariant, count(*) AS checks, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped FROM o GROUP BY 1""")
def invariant_summary(spark, sf):
    """All invariants counted."""
    return U.invariant_report(_all_checks(spark, sf))


@query(f"""
    SELECT 'I1' AS invariant, count(*) AS failures FROM ev WHERE doc_id % 50 = 0 OR doc_id % 60 = 1 UNION ALL SELECT 'I2', count(*) FROM runs WHERE run_id % 13 = 0
    UNION ALL SELECT 'I3', count(*) FROM returned WHERE run_id % 13 <> 0 AND evidence_id NOT IN {KNOWN_SQL}
    UNION ALL SELECT 'I4', count(*) FROM ev WHERE doc_id % 50 <> 0 AND doc_id % 60 = 1 UNION ALL SELECT 'I5', count(*) FROM runs WHERE run_id % 13 <> 0 AND run_id % 4 = 3
    UNION ALL SELECT 'I6', (SELECT count(*) FROM proposals WHERE source_run_id NOT IN (SELECT run_id FROM runs)) + (SELECT count(*) FROM decisions WHERE approvers_required IS NULL)""")
def invariant_failure_rows(spark, sf):
    """The failures themselves, counted per invariant."""
    return U.invariant_failures(_all_checks(spark, sf)).groupBy("invariant").agg(F.count("detail").alias("failures"))
