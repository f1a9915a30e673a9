"""Recorded runs: rollups, lineage, replay, workflow steps, report facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchspark import schemas
from vouchspark.operators import retrieval as R
from vouchspark.operators.scaling import hot_key_join
from vouchspark.session import reliable_checkpoint

SUMMARY_CHARS = 240
TOKEN_TOTALS = {
    "total_input_tokens": "input_tokens", "total_output_tokens": "output_tokens",
    "total_cache_read": "cache_read_input_tokens", "total_cache_creation": "cache_creation_input_tokens",
}


def summarize_output(output: Column) -> Column:
    """JSON text of an output, cut to 240 characters; empty gives NULL."""
    cut = F.concat(F.substring(output, 1, SUMMARY_CHARS - 3), F.lit("..."))
    return F.when(F.trim(output).isin("", "{}"), F.lit(None)).otherwise(
        F.when(F.length(output) <= SUMMARY_CHARS, output).otherwise(cut)
    )


def finalize_runs(traces: DataFrame, *extra: Column) -> DataFrame:
    """Run rows from trace documents, with ``extra`` columns if wanted.  All calls of a run
    sit in its own row, so totals are summed there and nothing is shuffled."""

    def total(field: str) -> Column:
        return F.aggregate("llm_calls", F.lit(0).cast("long"), lambda acc, call: acc + F.coalesce(call[field], F.lit(0)))

    totals = [total(field).alias(name) for name, field in TOKEN_TOTALS.items()]
    identity = [c for c in ("run_id", "directive", "skill", "workspace", "corpus_version", "started_at", "ended_at", "status", "error_message") if c in traces.columns]
    return traces.select(
        *identity, F.get("llm_calls", F.lit(0))["model"].alias("model"), *totals,
        F.size("llm_calls").cast("long").alias("n_calls"), summarize_output(F.col("output")).alias("output_summary"), *extra,
    )


def rollup_calls(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """The same from flat tables: calls are summed per run before they meet the runs."""
    per_run = calls.groupBy("run_id").agg(
        *[F.sum(field).alias(name) for name, field in TOKEN_TOTALS.items()],
        F.min_by("model", "pos").alias("model"), F.count(F.lit(1)).alias("n_calls"),
    )
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in (*TOKEN_TOTALS, "n_calls")]
    return runs.join(per_run, "run_id", "left").select(*runs.columns, "model", *zero)


def retrieval_rows(traces: DataFrame) -> DataFrame:
    """One row per returned chunk of every trace."""
    return traces.select("run_id", F.explode("retrieval.returned").alias("r")).select(
        "run_id", "r.chunk_id", "r.evidence_id", "r.rank", F.col("r.bm25_score").alias("score")
    )


def run_evidence(retrieved: DataFrame, supporting: DataFrame, contradicting: DataFrame) -> DataFrame:
    """Upsert by (run, chunk, role), the last write wins.

    ``retrieved`` has rank and score; the cited tables have (run_id, chunk_id).  ``pos`` is
    the order of writing inside a run where a table has it."""

    def role(df: DataFrame, name: str) -> DataFrame:
        pick = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
        return df.select(
            "run_id", "chunk_id", F.lit(name).alias("role"), pick("rank", "int").cast("int").alias("rank"),
            pick("score", "double").alias("score"), F.coalesce(pick("pos", "long").cast("long"), F.lit(0)).alias("pos"),
        )

    rows = role(retrieved, "retrieved").unionByName(role(supporting, "supporting")).unionByName(role(contradicting, "contradicting"))
    last = F.max(F.struct("pos", "rank", "score")).alias("w")
    return rows.groupBy("run_id", "chunk_id", "role").agg(last).select("run_id", "chunk_id", "role", "w.rank", "w.score")


def list_runs(runs: DataFrame, skill: str | None = None, limit: int = 20) -> DataFrame:
    """Newest runs first, ties by id."""
    found = runs if skill is None else runs.filter(F.col("skill") == skill)
    return found.orderBy(F.col("started_at").desc(), F.col("run_id").asc()).limit(limit)


def get_traces(traces: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces found, ids missing)."""
    return traces.join(ids.select("run_id"), "run_id", "left_semi"), ids.join(traces.select("run_id"), "run_id", "left_anti")


def trace_version(col: Column | None = None) -> Column:
    return F.coalesce(col if col is not None else F.col("schema_version"), F.lit(1))


def gate_schema(traces: DataFrame) -> DataFrame:
    """``version`` (1 where it is missing) and whether it is supported."""
    versioned = traces.withColumn("version", trace_version())
    return versioned.withColumn("accepted", F.col("version").isin(*schemas.TRACE_VERSIONS))


# --- replay ----------------------------------------------------------------------------------------
def replay_kwargs(traces: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Arguments a replay uses: the pinned map if the trace has one, else the current
    defaults overlaid with the recorded inputs without ``workspace`` and ``_`` keys."""
    own = F.map_filter("inputs", lambda k, _: (k != "workspace") & ~F.startswith(k, F.lit("_")))
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]) if defaults else F.create_map().cast("map<string,string>")
    unset = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    pinned = F.col("effective_kwargs")
    # An empty pinned map is used as it is, yet named a legacy source.
    source = F.when(pinned.isNotNull() & (F.size(pinned) > 0), "effective_kwargs").otherwise("legacy_inputs")
    return traces.withColumn("kwargs", F.coalesce(pinned, F.map_concat(unset, own))).withColumn("kwargs_source", source)


def replay_requests(traces: DataFrame, defaults: dict[str, str], *, live: bool = False) -> DataFrame:
    """Recorded runs as questions: claim from the arguments, version pinned unless live."""
    resolved = replay_kwargs(gate_schema(traces).filter("accepted"), defaults)
    version = F.lit(2**31 - 1).cast("long") if live else F.col("corpus_version").cast("long")
    return resolved.select(
        F.col("run_id").alias("query_id"), F.try_element_at("kwargs", F.lit("claim")).alias("query"), version.alias("as_of"),
        "kwargs_source", F.lit("live" if live else "frozen").alias("mode"), F.col("corpus_version").alias("original_corpus_version"),
        "workspace" if "workspace" in traces.columns else F.lit(None).cast("string").alias("workspace"), "kwargs", "inputs",
    )


def replay(requests: DataFrame, index: R.Index, k: int = 10) -> DataFrame:
    """Retrieval of every recorded run at its own version, one job for all runs."""
    return R.bm25_topk(requests.select("query_id", "query", "as_of"), index, k, version_per_query=True)


def chunk_sets(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Chunk ids per run, sorted; a run has at most k."""
    return hits.groupBy(key).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def replay_diff(old: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """What changed between original and replay: method, label, confidence, chunks."""
    fields = [c for c in ("method", "label", "confidence", "chunk_ids") if c in old.columns and c in new.columns]
    right = new.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = old.select(key, *fields).join(right, key)
    out = [key]
    for c in fields:
        if c == "chunk_ids":
            out.append(F.array_except("chunk_ids", "new_chunk_ids").alias("lost_chunks"))
            out.append(F.array_except("new_chunk_ids", "chunk_ids").alias("gained_chunks"))
        else:
            changed = ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
            if c == "method":
                changed = changed & F.col(c).isNotNull() & F.col("new_method").isNotNull()
            out.append(changed.alias(f"{c}_changed"))
    return joined.select(*out)


# --- lineage -----------------------------------------------------------------------------------------
def lineage(traces: DataFrame) -> DataFrame:
    """Parent, step, replay and evaluation links of every run, from its inputs."""
    link = lambda key: F.try_element_at("inputs", F.lit(key))
    return traces.select(
        F.col("run_id").cast("string").alias("run_id"), link("_parent_run").alias("parent_run"),
        link("_step_index").cast("int").alias("step_index"), link("_replay_of").alias("replay_of"), link("_eval_id").alias("eval_id"),
    )


def ancestry(links: DataFrame, max_rounds: int = 32) -> DataFrame:
    """Root run and depth of every run.

    Pointers are doubled each round (parent, grandparent, 4th, 8th, …), so a chain of
    depth d takes log2(d) joins; each round is checkpointed.  A parent that is not in the
    table ends the chain.  Runs one job per round; a cycle raises.
    """
    ids = links.select(F.col("run_id").alias("parent_run"), F.lit(True).alias("known")).distinct()
    # Roots have no parent to look up; joined, they would all meet under the NULL key.
    rooted = links.filter(F.col("parent_run").isNull()).select("parent_run", "run_id", F.lit(None).cast("boolean").alias("known"))
    known = links.filter(F.col("parent_run").isNotNull()).select("run_id", "parent_run").join(ids, "parent_run", "left").unionByName(rooted)
    state = known.select(
        "run_id", F.when(F.col("known"), F.col("parent_run")).otherwise(F.col("run_id")).alias("root"),
        F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"),
    )
    state = reliable_checkpoint(state)
    for _ in range(max_rounds):
        up = state.select(F.col("run_id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = hot_key_join(state, up, "root").select("run_id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), "more")
        joined = reliable_checkpoint(joined)
        state = joined.drop("more")
        if joined.filter(F.col("more") > 0).isEmpty():
            return state
    raise ValueError("lineage has a cycle")


STEP = "step_index int, skill string, directive string, child_run_id string, status string, error string, description string, fanout boolean"


def workflow_steps(traces: DataFrame) -> DataFrame:
    """Steps recorded in the events of a run; failed ones keep their child run id."""
    steps = F.filter("events", lambda e: e["key"] == "workflow_step")
    exploded = traces.select("run_id", F.explode(steps).alias("e"))
    return exploded.select("run_id", F.from_json("e.value", STEP).alias("s")).select(
        "run_id", "s.*"
    ).withColumn("fanout", F.coalesce("fanout", F.lit(False)))


def step_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"),
        F.bool_or("fanout").alias("fanout"),
    )


# --- report facts --------------------------------------------------------------------------------------
def report_totals(traces: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for a set of runs: tokens, calls, verdict counters, replays."""
    chosen = traces.join(ids.select("run_id"), "run_id", "left_semi")
    label = F.get_json_object("output", "$.label")
    replay_of = F.try_element_at("inputs", F.lit("_replay_of"))
    label_is = lambda name: F.count_if(F.col("label") == name).alias(name)
    return finalize_runs(chosen, label.alias("label"), replay_of.alias("replay_of")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("total_input_tokens").alias("input_tokens"),
        F.sum("total_output_tokens").alias("output_tokens"), F.sum("n_calls").alias("llm_calls"),
        label_is("supported"), label_is("partial"), label_is("contradicted"), F.count("replay_of").alias("replays"),
    )


def report_values(traces: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct workspaces, models and versions of the runs with the position where each is
    first seen.  ``ids`` carries ``pos``."""
    chosen = finalize_runs(traces).join(ids.select("run_id", "pos"), "run_id")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in ("workspace", "model", "corpus_version")])
    )
    rows = chosen.select("pos", pairs.alias("p")).filter(F.coalesce("p.value", F.lit("")) != "")
    return rows.groupBy("p.kind", "p.value").agg(F.min("pos").alias("first_seen"))


# --- fan-out ---------------------------------------------------------------------------------------------
def fanout(
    inputs: DataFrame, fn: Callable[[dict], str], *, fail_fast: bool = False, parallelism: int | None = None
) -> DataFrame:
    """Run a skill over many inputs: (step_index, status, output, error) in input order.

    A failing row becomes an error row; with ``fail_fast`` reading the result fails."""
    if parallelism is not None:
        inputs = inputs.repartition(parallelism, "step_index")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for record in frame.to_dict("records"):
                try:
                    rows.append((record["step_index"], "ok", fn(record), None))
                except Exception as fault:  # noqa: BLE001
                    rows.append((record["step_index"], "error", None, f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(rows, columns=["step_index", "status", "output", "error"])

    done = inputs.mapInPandas(run, "step_index long, status string, output string, error string")
    if fail_fast:
        fine = F.assert_true(F.col("status") == "ok", F.concat(F.lit("step failed: "), F.col("error")))
        done = done.filter(fine.isNull())
    return done.orderBy("step_index")

