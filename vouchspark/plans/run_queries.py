"""Queries over recorded runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchspark.operators import retrieval as R
from vouchspark.operators import runs as T
from vouchspark.plans import derived as D
from vouchspark.plans.registry import query

RUN_SQL = """
    SELECT r.run_id, r.status, c.model, coalesce(c.total_input_tokens, 0) AS total_input_tokens, coalesce(c.total_output_tokens, 0) AS total_output_tokens,
           coalesce(c.total_cache_read, 0) AS total_cache_read, coalesce(c.n_calls, 0) AS n_calls FROM runs r LEFT JOIN rollup_calls c ON c.run_id = r.run_id"""
RUN_COLUMNS = ("run_id", "status", "model", "total_input_tokens", "total_output_tokens", "total_cache_read", "n_calls")


@query(RUN_SQL)
def run_rollup(spark, sf):
    """Token totals and first model per run, from trace documents."""
    return T.finalize_runs(D.traces(spark, sf)).select(*RUN_COLUMNS)


@query(RUN_SQL)
def run_rollup_flat(spark, sf):
    """The same from flat call rows."""
    return T.rollup_calls(D.runs(spark, sf), D.llm_calls(spark, sf)).select(*RUN_COLUMNS)


@query("""
    SELECT run_id, CASE WHEN length(o) <= 240 THEN o ELSE substr(o, 1, 237) || '...' END AS output_summary FROM (
      SELECT run_id, CASE WHEN status = 'ok' THEN '{"label":"' || (['supported','contradicted','partial','not_found'])[CAST(run_id % 4 AS INTEGER) + 1]
             || '","claim":"' || repeat('claim ' || run_id || ' ', CAST(run_id % 40 AS INTEGER)) || '"}' END AS o FROM runs)""")
def output_summaries(spark, sf):
    """Outputs cut to 240 characters."""
    return T.finalize_runs(D.traces(spark, sf)).select("run_id", "output_summary")


@query("""
    WITH w AS (SELECT run_id, chunk_id, 'retrieved' AS role, CAST(rank AS INTEGER) AS rank, score, rank AS pos FROM returned
      UNION ALL SELECT run_id, chunk_id, 'retrieved', CAST(rank + 10 AS INTEGER), score, rank + 100 FROM returned WHERE rank = 0
      UNION ALL SELECT run_id, chunk_id, 'supporting', NULL, NULL, 0 FROM returned WHERE rank = 1
      UNION ALL SELECT run_id, chunk_id, 'contradicting', NULL, NULL, 0 FROM returned WHERE rank = 2)
    SELECT run_id, chunk_id, role, rank, score FROM w QUALIFY row_number() OVER (PARTITION BY run_id, chunk_id, role ORDER BY pos DESC) = 1""")
def run_evidence_rows(spark, sf):
    """Evidence roles per run; a row written twice keeps its last values."""
    rows = T.retrieval_rows(D.traces(spark, sf))
    again = rows.filter(F.col("rank") == 0).select("run_id", "chunk_id", (F.col("rank") + 10).alias("rank"), "score", (F.col("rank") + 100).alias("pos"))
    written = rows.select("run_id", "chunk_id", "rank", "score", F.col("rank").alias("pos")).unionByName(again)
    return T.run_evidence(written, rows.filter(F.col("rank") == 1).select("run_id", "chunk_id"), rows.filter(F.col("rank") == 2).select("run_id", "chunk_id"))


@query("SELECT run_id, skill, started_at FROM runs WHERE skill = 'verify_claim' ORDER BY started_at DESC, run_id LIMIT 20")
def newest_runs(spark, sf):
    """T4: the twenty newest runs of a skill."""
    return T.list_runs(D.runs(spark, sf), "verify_claim").select("run_id", "skill", "started_at")


@query("""
    SELECT DISTINCT l_suppkey * 400 AS run_id, l_suppkey * 400 IN (SELECT run_id FROM runs) AS found FROM lineitem""")
def traces_by_id(spark, sf):
    """T5: asked-for runs that exist, and ids that do not."""
    ids = D.load(spark, sf, "lineitem").select((F.col("l_suppkey") * 400).alias("run_id")).distinct()
    found, missing = T.get_traces(D.traces(spark, sf), ids)
    return found.select("run_id", F.lit(True).alias("found")).unionByName(missing.select("run_id", F.lit(False).alias("found")))


@query("""
    SELECT CASE WHEN run_id % 4 = 0 THEN 1 ELSE run_id % 4 END AS version, run_id % 4 <> 3 AS accepted, count(*) AS runs FROM runs GROUP BY ALL""")
def trace_versions(spark, sf):
    """Accepted and refused trace versions."""
    return T.gate_schema(D.traces(spark, sf)).groupBy("version", "accepted").agg(F.count(F.lit(1)).alias("runs"))


@query("""
    SELECT run_id, 'claim ' || run_id AS claim, CASE WHEN run_id % 2 = 0 THEN CAST(run_id % 20 AS VARCHAR) ELSE '10' END AS k,
           CASE WHEN run_id % 2 = 0 THEN NULL ELSE '50' END AS pool, CASE WHEN run_id % 2 = 0 THEN 2 ELSE 3 END AS n_keys,
           CASE WHEN run_id % 2 = 0 THEN 'effective_kwargs' ELSE 'legacy_inputs' END AS kwargs_source FROM runs""")
def replay_arguments(spark, sf):
    """Arguments of a replay, pinned or rebuilt."""
    found = T.replay_kwargs(D.traces(spark, sf), {"k": "10", "pool": "50", "claim": "none"})
    pick = lambda key: F.try_element_at("kwargs", F.lit(key)).alias(key)
    return found.select("run_id", pick("claim"), pick("k"), pick("pool"), F.size("kwargs").alias("n_keys"), "kwargs_source")


def _recorded_runs(spark, sf):
    return D.questions(spark, sf).withColumn("as_of", F.col("query_id") * 5 + 100)


FROZEN_SQL = """
    frozen AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) - 1 AS rank FROM (
      SELECT query_id, chunk_id, round(-sum(gain), 6) AS score FROM scored WHERE corpus_version <= query_id * 5 + 100 GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) <= 10)"""


@query(f"WITH {FROZEN_SQL} SELECT query_id, chunk_id, score, rank FROM frozen")
def frozen_replay(spark, sf):
    """Every recorded question asked again at its own corpus version."""
    return T.replay(_recorded_runs(spark, sf), R.build_index(D.stored_ch(spark, sf, versioned=True)))


@query(f"""
    WITH {FROZEN_SQL},
    o AS (SELECT query_id, list(chunk_id) AS a FROM frozen GROUP BY 1), n AS (SELECT claim_id, list(chunk_id) AS b FROM hits GROUP BY 1)
    SELECT query_id AS run_id, query_id % 3 = 0 AS method_changed, len([x FOR x IN a IF NOT list_contains(b, x)]) AS lost, len([x FOR x IN b IF NOT list_contains(a, x)]) AS gained
    FROM o JOIN n ON n.claim_id = o.query_id""")
def replay_drift(spark, sf):
    """Frozen against live: methods and chunk sets that differ."""
    index = R.build_index(D.stored_ch(spark, sf, versioned=True))
    asked = _recorded_runs(spark, sf)
    old = T.chunk_sets(T.replay(asked, index)).withColumn("method", F.when(F.col("query_id") % 3 == 0, "hybrid_rrf").otherwise("bm25"))
    new = T.chunk_sets(R.bm25_topk(asked, index, 10)).withColumn("method", F.lit("bm25"))
    found = T.replay_diff(old.withColumnRenamed("query_id", "run_id"), new.withColumnRenamed("query_id", "run_id"))
    return found.select("run_id", "method_changed", F.size("lost_chunks").cast("long").alias("lost"), F.size("gained_chunks").cast("long").alias("gained"))


@query("""
    SELECT CAST(run_id AS VARCHAR) AS run_id, CASE WHEN run_id % 3 <> 0 THEN CAST(run_id - 1 AS VARCHAR) END AS parent_run, CASE WHEN run_id % 3 <> 0 THEN run_id % 3 - 1 END AS step_index,
           CASE WHEN run_id % 10 = 0 THEN CAST(run_id - 5 AS VARCHAR) END AS replay_of, CASE WHEN run_id % 4 = 1 THEN 'eval' || (run_id % 9) END AS eval_id FROM runs""")
def run_links(spark, sf):
    """Parent, replay and evaluation links."""
    return T.lineage(D.traces(spark, sf)).withColumn("step_index", F.col("step_index").cast("long"))


@query("SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(run_id - run_id % 3 AS VARCHAR) AS root, run_id % 3 AS depth FROM runs")
def run_ancestry(spark, sf):
    """Root and depth of every run."""
    return T.ancestry(T.lineage(D.traces(spark, sf)))


@query("SELECT run_id, step_index, child_run_id, status, fanout FROM steps")
def workflow_step_rows(spark, sf):
    """Steps of workflows."""
    found = T.workflow_steps(D.traces(spark, sf))
    return found.select("run_id", F.col("step_index").cast("long"), "child_run_id", "status", "fanout")


@query("SELECT run_id, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, bool_or(fanout) AS fanout FROM steps GROUP BY 1")
def workflow_step_counts(spark, sf):
    """Good and failed steps per workflow."""
    return T.step_counts(T.workflow_steps(D.traces(spark, sf)))


def _report_ids(spark, sf):
    return D.load(spark, sf, "orders").select((F.col("o_orderkey") * 7).alias("run_id"), (F.col("o_orderkey") * 37 % 1009 * 100000 + F.col("o_orderkey")).alias("pos"))


IDS_SQL = "ids AS (SELECT o_orderkey * 7 AS run_id, o_orderkey * 37 % 1009 * 100000 + o_orderkey AS pos FROM orders)"


@query(f"""
    WITH {IDS_SQL}, r AS (SELECT x.*, y.skill FROM ({RUN_SQL}) x JOIN runs y ON y.run_id = x.run_id JOIN ids ON ids.run_id = x.run_id)
    SELECT count(*) AS runs, CAST(sum(total_input_tokens) AS BIGINT) AS input_tokens, CAST(sum(total_output_tokens) AS BIGINT) AS output_tokens, CAST(sum(n_calls) AS BIGINT) AS llm_calls,
           count(*) FILTER (status = 'ok' AND run_id % 4 = 0) AS supported, count(*) FILTER (status = 'ok' AND run_id % 4 = 2) AS partial,
           count(*) FILTER (status = 'ok' AND run_id % 4 = 1) AS contradicted, count(*) FILTER (run_id % 10 = 0) AS replays FROM r""")
def report_totals(spark, sf):
    """Totals and verdict counters of a report."""
    return T.report_totals(D.traces(spark, sf), _report_ids(spark, sf))


@query(f"""
    WITH {IDS_SQL}, r AS (SELECT x.run_id, x.model, y.workspace, y.corpus_version, pos FROM ({RUN_SQL}) x JOIN runs y ON y.run_id = x.run_id JOIN ids ON ids.run_id = x.run_id)
    SELECT kind, value, min(pos) AS first_seen FROM (
      SELECT 'workspace' AS kind, workspace AS value, pos FROM r UNION ALL SELECT 'model', model, pos FROM r WHERE model IS NOT NULL
      UNION ALL SELECT 'corpus_version', CAST(corpus_version AS VARCHAR), pos FROM r) GROUP BY ALL""")
def report_values(spark, sf):
    """Distinct workspaces, models and versions in first-seen order."""
    return T.report_values(D.traces(spark, sf), _report_ids(spark, sf))


@query("""
    SELECT doc_id AS step_index, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 <> 0 THEN CAST(length(text) AS VARCHAR) END AS output,
           CASE WHEN doc_id % 5 = 0 THEN 'ValueError: refused' END AS error FROM documents""")
def fanned_out_steps(spark, sf):
    """A skill over many inputs; failures become rows."""

    def skill(record: dict) -> str:
        if record["step_index"] % 5 == 0:
            raise ValueError("refused")
        return str(len(record["text"]))

    return T.fanout(D.documents(spark, sf).select(F.col("doc_id").alias("step_index"), "text"), skill)


@query("SELECT run_id, chunk_id, evidence_id, rank, score FROM returned")
def recorded_retrieval(spark, sf):
    """Chunks returned to every run."""
    return T.retrieval_rows(D.traces(spark, sf)).withColumn("rank", F.col("rank").cast("long"))
