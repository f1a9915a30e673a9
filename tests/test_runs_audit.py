import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vouchspark import schemas
from vouchspark.operators import audit as U
from vouchspark.operators import runs as T
from vouchspark.operators import scaling
from vouchspark.sources import audit_tables as AT
from vouchspark.sources import traces as TS


def trace(run_id, started="2024-05-03T00:00:00.000Z", **over):
    base = {f.name: None for f in schemas.TRACE.fields}
    return {**base, "run_id": run_id, "started_at": started, "inputs": {}, "events": [], "llm_calls": [], "status": "ok", **over}


def test_traces_round_trip_by_month(spark, tmp_path):
    call = {"call_id": "c", "model": "m1", "input_tokens": 5, "output_tokens": 1, "cache_read_input_tokens": None, "cache_creation_input_tokens": 0, "elapsed_ms": 3}
    rows = [trace("r1", llm_calls=[call, {**call, "model": "m2"}], output='{"label":"supported"}'), trace("r2", "2023-12-31T23:59:59.999Z")]
    TS.write_traces(spark.createDataFrame(rows, schemas.TRACE), str(tmp_path))
    assert (tmp_path / "year=2024" / "month=05").is_dir() and (tmp_path / "year=2023" / "month=12").is_dir()
    found = {r.run_id: r for r in T.finalize_runs(TS.read_traces(spark, str(tmp_path))).collect()}
    assert (found["r1"].model, found["r1"].total_input_tokens, found["r1"].total_cache_read) == ("m1", 10, 0)
    assert found["r1"].output_summary == '{"label":"supported"}' and found["r2"].output_summary is None


def test_pretty_printed_trace_files(spark, tmp_path):
    folder = tmp_path / "2024" / "05"
    folder.mkdir(parents=True)
    (folder / "r9.json").write_text(json.dumps(trace("r9", schema_version=2, inputs={"claim": "x"}), indent=2))
    row = TS.read_traces(spark, str(tmp_path), multi_line=True).first()
    assert (row.run_id, row.inputs["claim"]) == ("r9", "x")


def test_items(spark, tmp_path):
    lines = [json.dumps({"id": f"i{n}", "passage": "p", "label": "PASS", "source_ds": "A" if n % 2 else "B"}) for n in range(9)]
    (tmp_path / "items.jsonl").write_text("\n".join(lines))
    assert [r.id for r in TS.read_items(spark, str(tmp_path / "items.jsonl"), "A", 2).collect()] == ["i1", "i3"]


def test_summary_lengths(spark):
    texts = ["x" * 240, "x" * 241, "", "{}", None]
    df = spark.createDataFrame([(t,) for t in texts], "o string")
    out = [r[0] for r in df.select(T.summarize_output(F.col("o"))).collect()]
    assert out == ["x" * 240, "x" * 237 + "...", None, None, None]


def test_replay_arguments(spark):
    rows = [trace("a", effective_kwargs={"k": "3"}, inputs={"claim": "c"}), trace("b", inputs={"workspace": "w", "_x": "1", "claim": "c", "k": "9"}), trace("c", effective_kwargs={})]
    found = {r.run_id: (r.kwargs, r.kwargs_source) for r in T.replay_kwargs(spark.createDataFrame(rows, schemas.TRACE), {"k": "10", "pool": "50"}).collect()}
    assert found["a"] == ({"k": "3"}, "effective_kwargs")
    assert found["b"] == ({"k": "9", "pool": "50", "claim": "c"}, "legacy_inputs")
    assert found["c"] == ({}, "legacy_inputs")


def test_replay_requests_pin_the_version(spark):
    rows = [trace("a", corpus_version=4, effective_kwargs={"claim": "q"}, schema_version=2), trace("b", corpus_version=4, schema_version=3)]
    df = spark.createDataFrame(rows, schemas.TRACE)
    assert [(r.query_id, r.query, r.as_of, r.mode) for r in T.replay_requests(df, {}).collect()] == [("a", "q", 4, "frozen")]
    assert T.replay_requests(df, {}, live=True).first().as_of > 10**9


def test_long_lineage_and_hot_root(spark):
    """A chain of 100 runs, a root with very many children, a parent that is not there."""
    rows = [(str(i), str(i - 1) if i % 100 else None) for i in range(200)] + [(f"x{i}", "0") for i in range(300)] + [("lost", "gone")]
    links = spark.createDataFrame(rows, "run_id string, parent_run string")
    found = {r.run_id: (r.root, r.depth) for r in T.ancestry(links).collect()}
    assert found["99"] == ("0", 99) and found["150"] == ("100", 50) and found["x7"] == ("0", 1) and found["lost"] == ("lost", 0)
    assert len(found) == len(rows)
    with pytest.raises(ValueError, match="cycle"):
        T.ancestry(spark.createDataFrame([("a", "b"), ("b", "a")], "run_id string, parent_run string"), max_rounds=4)


def test_hot_key_join_equals_plain_join(spark):
    big = spark.range(1000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    unique = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "id", "v").collect())
    assert rows(scaling.hot_key_join(big, unique, "k", hot_rows=30)) == rows(big.join(unique, "k"))
    left = lambda df: sorted(str(tuple(r)) for r in df.select("k", "id", "v").collect())
    assert left(scaling.salted_join(big, unique, "k", "left", ["id"])) == left(big.join(unique, "k", "left"))


def test_repeated_rows_of_a_salted_join_count_for_a_broadcast(spark):
    """Rows that fit a broadcast once but not ``salts`` times are not sent through the driver."""
    big, unique = spark.range(1_000_000).select((F.col("id") % 1000).alias("k"), "id"), spark.range(1000).select(F.col("id").alias("k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = scaling.salted_join(big, unique, "k", "left", ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan


def test_running_sums_and_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit(2).alias("w")).repartition(6)
    found = sorted(tuple(r) for r in scaling.running_sums(df, [F.col("x").asc()], {"total": "w"}).select("x", "total").collect())
    assert found == [(i, 2 * (i + 1)) for i in range(1000)]
    tied = spark.range(400).select(F.lit("same").alias("t"), "id")
    assert sorted((r.id, r.n) for r in scaling.global_positions(tied, ["t", "id"], "n").collect()) == [(i, i + 1) for i in range(400)]


def test_fanout_keeps_failures(spark):
    df = spark.range(20).select(F.col("id").alias("step_index"))
    skill = lambda record: str(1 // (record["step_index"] % 2))
    rows = T.fanout(df, skill, parallelism=3).collect()
    assert [r.step_index for r in rows] == list(range(20)) and rows[0].error.startswith("ZeroDivisionError") and rows[1].output == "1"
    with pytest.raises(Exception, match="step failed"):
        T.fanout(df, skill, fail_fast=True).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("b.txt", b"two"), ("sub/a.txt", b"one")):
        (tmp_path / name).write_bytes(data)
    rows = U.manifest(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.sha256) for r in rows] == [("b.txt", hashlib.sha256(b"two").hexdigest()), ("a.txt", hashlib.sha256(b"one").hexdigest())]


def test_audit_files_and_refusal(spark, tmp_path):
    runs = spark.createDataFrame([(1, None, "x")], "run_id long, model string, note string")
    AT.write_audit({"runs": AT.union_columns([runs, runs.select("run_id", F.lit("new").alias("extra"))])}, str(tmp_path))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "runs").glob("*.csv")))
    assert "run_id,model,note,extra" in text and "1,,x," in text and "1,,,new" in text
    traces = spark.createDataFrame([(2,)], "run_id long")
    with pytest.raises(Exception, match="run without trace: 1"):
        U.refuse_missing(runs, traces).collect()
    assert U.refuse_missing(runs.withColumn("run_id", F.lit(2).cast("long")), traces).count() == 1


def test_range_ends_compare_as_text(spark):
    runs = spark.createDataFrame([(1, "2026-05-31T10:00:00.000Z"), (2, "2026-05-30T10:00:00.000Z")], "run_id long, started_at string")
    kept = AT.between_text(runs, "started_at", "2026-05-30", "2026-05-31")
    assert [r.run_id for r in kept.collect()] == [2]


def test_growing_keys_are_not_sent_through_the_driver(spark):
    """Checks and salted inner joins shuffle both sides, however small Spark takes them to be."""
    runs, paths = spark.range(50).withColumnRenamed("id", "run_id"), spark.range(50).select(F.col("id").cast("string").alias("path"), F.lit("h").alias("sha256"))
    evidence = paths.select(F.col("path").alias("evidence_id"), F.col("path").alias("source_path"), "sha256")
    big = spark.range(1000).select((F.col("id") % 50).alias("run_id"), "id")
    for found in (U.check_i1(paths, paths), U.check_i2(runs, runs), U.check_i4(evidence, paths), scaling.salted_join(big, runs, "run_id", "inner", ["id"])):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() in (50, 1000)


def test_new_contents_and_left_salted_joins_stay_off_the_driver(spark):
    from vouchspark.operators import corpus as C

    docs = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 20).cast("string").alias("text"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    fresh = C.new_evidence(docs)
    assert "BroadcastHashJoin" not in plan(fresh) and sorted(r.doc_id for r in fresh.collect()) == list(range(20))
    joined = scaling.salted_join(docs, fresh.select("doc_id", "sha256"), "doc_id", "left", ["text"])
    assert "BroadcastHashJoin" not in plan(joined) and joined.count() == 60


def test_checks_derive_their_evidence_once(spark):
    from vouchspark.plans import audit_queries

    checks = audit_queries._all_checks(spark, "/root/testdata/sf0.001")
    assert all("sha2(" not in c._jdf.queryExecution().executedPlan().toString() for c in checks)


def test_written_traces_are_compressed(spark, tmp_path):
    row = {"run_id": "1", "skill": "verify_claim", "status": "ok", "started_at": "2024-05-01T00:00:00.000Z", "llm_calls": [{"model": "m", "input_tokens": 3}] * 500}
    TS.write_traces(spark.createDataFrame([row], schemas.TRACE), str(tmp_path))
    (file,) = tmp_path.glob("year=2024/month=05/part-*.json*")
    assert file.stat().st_size < 5000
    (back,) = TS.read_traces(spark, str(tmp_path)).collect()
    assert back.run_id == "1" and len(back.llm_calls) == 500 and {c.input_tokens for c in back.llm_calls} == {3}
