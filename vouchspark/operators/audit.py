"""Audit tables and the integrity checks over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchspark.operators.scaling import salted_join, unsent
from vouchspark.operators.runs import gate_schema, retrieval_rows, trace_version
from vouchspark.sources.corpus_source import all_files, file_hashes


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below ``path``, sorted by path.  Files are read piece by piece in
    tasks of about equal size, so one may be larger than a row or a task's memory."""
    return file_hashes(all_files(spark, path)).orderBy("path")


def flatten(approvals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approvals and decisions as one stream of text rows, columns of the other kind blank.

    ``order_key`` sorts all approvals first: (kind, time, id) as text, so that a writer that sorts by
    it, or a range partition over it, gives one order."""
    own = [
        "approval_id", "workspace", "directive", "skill", "source_run_id", "status", "summary", "approvers_required",
        "created_at", "decided_at", "decided_by", "decision_note",
    ]
    extra = ["decision_id", "decision", "decided_at_decision", "note"]
    text = lambda df, c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    first = approvals.select(
        F.lit("approval").alias("row_kind"), *[text(approvals, c).alias(c) for c in own], *[F.lit("").alias(c) for c in extra]
    )
    shown = {"approval_id": "approval_id", "decided_by": "decided_by", "decision_id": "decision_id", "decision": "decision",
             "decided_at_decision": "decided_at", "note": "note"}
    second = decisions.select(
        F.lit("decision").alias("row_kind"),
        *[(text(decisions, shown[c]) if c in shown else F.lit("")).alias(c) for c in [*own, *extra]],
    )
    both = first.unionByName(second)
    kind = F.when(F.col("row_kind") == "approval", "0").otherwise("1")
    when, own_id = (F.when(kind == "0", F.col(a)).otherwise(F.col(b)) for a, b in (("created_at", "decided_at_decision"), ("approval_id", "decision_id")))
    return both.withColumn("order_key", F.concat_ws("|", kind, when, F.lpad(own_id, 20, "0")))


def missing_traces(runs: DataFrame, traces: DataFrame) -> DataFrame:
    return runs.select("run_id").join(traces.select("run_id"), "run_id", "left_anti")


def refuse_missing(runs: DataFrame, traces: DataFrame) -> DataFrame:
    """Runs, all of which have a trace; reading the result fails at the first that has none."""
    held = traces.select("run_id", F.lit(True).alias("_held")).distinct()
    joined = runs.join(held, "run_id", "left")
    problem = F.concat(F.lit("run without trace: "), F.col("run_id").cast("string"))
    return joined.filter(F.assert_true(F.col("_held").isNotNull(), problem).isNull()).drop("_held")


def missing_files(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence rows whose stored file is gone.  An export that lists any is not self-contained."""
    return evidence.select("evidence_id", F.col("source_path").alias("path")).join(files.select("path"), "path", "left_anti")


def bundle_stats(counts: dict[str, DataFrame], traces: DataFrame) -> DataFrame:
    """Row count per table and the trace versions seen, in one row per fact."""
    sizes = [t.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(n).alias("fact"), "value") for n, t in counts.items()]
    versions = traces.select(trace_version().alias("v")).distinct().agg(
        F.array_join(F.array_sort(F.collect_set(F.col("v").cast("string"))), ",").alias("value")
    )
    return reduce(DataFrame.unionByName, [*sizes, versions.select(F.lit("trace_schema_versions_seen").alias("fact"), "value")])


# --- invariants: each gives (invariant, item, outcome, detail), outcome in passed / failed / skipped -----
def _checked(df: DataFrame, name: str, item: Column, failed: Column, detail: Column, skipped: Column | None = None) -> DataFrame:
    outcome = F.when(failed, "failed").otherwise("passed")
    if skipped is not None:
        outcome = F.when(skipped, "skipped").otherwise(outcome)
    return df.select(
        F.lit(name).alias("invariant"), item.cast("string").alias("item"), outcome.alias("outcome"),
        F.when(outcome == "failed", detail).alias("detail"),
    )


def check_i1(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Every listed file is there and has the recorded hash."""
    joined = listed.join(unsent(found.select("path", F.col("sha256").alias("actual"))), "path", "left")
    gone = F.col("actual").isNull()
    detail = F.when(gone, F.concat("path", F.lit(": not in bundle"))).otherwise(F.concat("path", F.lit(": hash mismatch")))
    return _checked(joined, "I1", F.col("path"), gone | (F.col("actual") != F.col("sha256")), detail)


def check_i2(runs: DataFrame, traces: DataFrame) -> DataFrame:
    """Every run has a trace."""
    held = traces.select("run_id", F.lit(True).alias("held")).distinct()
    joined = runs.select("run_id").join(unsent(held), "run_id", "left")
    return _checked(joined, "I2", F.col("run_id"), F.col("held").isNull(), F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(": trace missing")))


def check_i3(traces: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every retrieved chunk points at known evidence."""
    known = evidence.select("evidence_id", F.lit(True).alias("known")).distinct()
    rows = salted_join(retrieval_rows(traces).select("run_id", "evidence_id"), known, "evidence_id", "left", ["run_id"])
    detail = F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(": unknown evidence "), F.coalesce("evidence_id", F.lit("NULL")))
    return _checked(rows, "I3", F.col("run_id"), F.col("known").isNull(), detail)


def check_i4(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence hash equals its source where the source is still there."""
    source = files.select(F.col("path").alias("source_path"), F.col("sha256").alias("actual"))
    joined = evidence.select("evidence_id", "source_path", "sha256").join(unsent(source), "source_path", "left")
    gone = F.col("actual").isNull()
    return _checked(joined, "I4", F.col("evidence_id"), F.col("actual") != F.col("sha256"), F.concat("evidence_id", F.lit(": sha256 differs")), gone)


def check_i5(traces: DataFrame) -> DataFrame:
    """Every trace has a supported version."""
    gated = gate_schema(traces.select("run_id", "schema_version"))
    detail = F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(": version "), F.col("version").cast("string"))
    return _checked(gated, "I5", F.col("run_id"), ~F.col("accepted"), detail)


def check_i6(approvals: DataFrame, decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Approvals name known runs, decisions name known approvals."""
    run_ids = runs.select(F.col("run_id").alias("source_run_id"), F.lit(True).alias("known")).distinct()
    first = salted_join(approvals.select("approval_id", "source_run_id"), run_ids, "source_run_id", "left", ["approval_id"])
    ids = approvals.select("approval_id", F.lit(True).alias("known")).distinct()
    second = salted_join(decisions.select("decision_id", "approval_id"), ids, "approval_id", "left", ["decision_id"])
    unknown = F.col("known").isNull()
    return _checked(
        first, "I6", F.concat(F.lit("approval "), F.col("approval_id").cast("string")), unknown, F.concat(F.lit("unknown run "), F.col("source_run_id").cast("string"))
    ).unionByName(
        _checked(second, "I6", F.concat(F.lit("decision "), F.col("decision_id").cast("string")), unknown, F.concat(F.lit("unknown approval "), F.col("approval_id").cast("string")))
    )


def invariant_report(checks: list[DataFrame]) -> DataFrame:
    """Checks, passed, failed, skipped per invariant.  Each input is counted on its own, so
    only six partial rows meet."""
    count = lambda outcome: F.count_if(F.col("outcome") == outcome).alias(outcome)
    return reduce(DataFrame.unionByName, checks).groupBy("invariant").agg(
        F.count(F.lit(1)).alias("checks"), count("passed"), count("failed"), count("skipped")
    )


def invariant_failures(checks: list[DataFrame]) -> DataFrame:
    """The failures themselves, one row each."""
    return reduce(DataFrame.unionByName, checks).filter(F.col("outcome") == "failed").select("invariant", "item", "detail")
