"""Whole jobs on a small corpus of plain statements."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vouchspark import schemas
from vouchspark.operators import retrieval as R
from vouchspark.operators import runs as T
from vouchspark.plans import jobs
from vouchspark.sources import traces as TS

DOCS = [
    (1, "# Storage\nThe archive keeps every ledger in a parquet table.", "docs/storage.md"),
    (2, "# Roads\nThe bridge over the river opened in spring.", "docs/roads.md"),
    (3, "# Copy\nother text entirely about whales", "docs/copy.md"),
    (4, "# Copy\nother text entirely about whales", "docs/copy2.md"),
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    batch = spark.createDataFrame([(*d, "text/markdown") for d in DOCS], "doc_id long, text string, source_path string, mime_type string")
    evidence, chunks = jobs.ingest_documents(batch, target=50, overlap=5)
    evidence.write.parquet(f"{root}/evidence")
    chunks.write.parquet(f"{root}/chunks")
    evidence, chunks = spark.read.parquet(f"{root}/evidence"), spark.read.parquet(f"{root}/chunks")
    return R.Corpus(chunks, evidence, R.build_index(chunks))


def claim_rows(spark, rows):
    return spark.createDataFrame(rows, "claim_id long, claim string, mode string")


def test_ingest(corpus):
    rows = {r.doc_id: (r.title, r.corpus_version) for r in corpus.evidence.collect()}
    assert rows == {1: ("Storage", 1), 2: ("Roads", 2), 3: ("Copy", 3)}
    assert {r.headings_path for r in corpus.chunks.collect()} == {"Storage", "Roads", "Copy"}


def test_every_mode_gives_one_verdict(spark, corpus):
    claim = "The archive keeps every ledger in a parquet table"
    rows = [(i, claim, m) for i, m in enumerate(("evidence", "judgment", "binary", "arithmetic", "decomposed", "tiered"))]
    rows += [(6, "zzz qqq", "evidence"), (7, "whales sing opera loudly tonight", "tiered"), (8, "The bridge opened. Whales fly purple.", "decomposed")]
    verdicts, hits = jobs.verify_claims(claim_rows(spark, rows), corpus, threshold=0.9)
    found = {r.claim_id: r for r in verdicts.collect()}
    assert len(found) == len(rows) == verdicts.count()
    assert [found[i].label for i in range(6)] == ["supported"] * 6
    assert found[0].supporting_chunk_ids and found[1].supporting_chunk_ids and not found[2].supporting_chunk_ids
    assert (found[6].label, found[6].confidence, found[6].missing_information) == ("not_found", 1.0, "Any evidence relevant to the claim.")
    assert found[7].label == "not_found" and found[7].mode == "tiered"
    assert found[8].reasoning == "Decomposed into 2 atoms."
    methods = {(r.claim_id, r.method) for r in hits.select("claim_id", "method").distinct().collect()}
    # A claim without a passage is matched by words in every mode.
    assert {m for _, m in methods} == {"bm25"}


def test_judge_is_not_asked_about_claims_without_hits(spark, corpus, tmp_path):
    def judge_fn(frame):
        assert not frame["claim"].str.contains("zzz").any()
        return pd.DataFrame({
            "claim_id": frame["claim_id"], "label": "supported", "confidence": 0.9, "reasoning": "see " + "F" * 26,
            "supporting_chunk_ids": [["F" * 26]] * len(frame), "contradicting_chunk_ids": [[]] * len(frame), "missing_information": None,
        })

    schema = "claim_id long, label string, confidence double, reasoning string, supporting_chunk_ids array<string>, contradicting_chunk_ids array<string>, missing_information string"
    rows = [(1, "ledger", "evidence"), (2, "zzz", "evidence")]
    found = {r.claim_id: r for r in jobs.verify_claims(claim_rows(spark, rows), corpus, jobs.prompted(judge_fn, schema, 2))[0].collect()}
    assert (found[1].label, found[1].reasoning, found[1].supporting_chunk_ids) == ("not_found", "see [unverified-id]", [])
    assert found[2].confidence == 1.0


def test_snapshots_hide_later_documents(spark, corpus):
    asked = claim_rows(spark, [(1, "whales", "evidence"), (2, "whales", "evidence")]).withColumn("as_of", F.when(F.col("claim_id") == 1, 2).cast("long"))
    found = {r.claim_id: r.label for r in jobs.verify_claims(asked, corpus)[0].collect()}
    assert found == {1: "not_found", 2: "supported"}


def test_recorded_runs_replay_without_drift(spark, corpus, tmp_path):
    asked = claim_rows(spark, [(1, "ledger in a parquet table", "evidence"), (2, "bridge opened in winter", "evidence")])
    verdicts, hits = jobs.verify_claims(asked, corpus)
    TS.write_traces(jobs.as_traces(verdicts, hits, workspace="w", started_at="2024-05-01T00:00:00.000Z", corpus_version=3), str(tmp_path))
    stored = TS.read_traces(spark, str(tmp_path))
    assert stored.count() == 2 and T.gate_schema(stored).filter("accepted").count() == 2
    assert stored.schema == schemas.TRACE
    again, drift = jobs.replay_runs(stored, corpus)
    assert sorted(r.label for r in again.collect()) == sorted(r.label for r in verdicts.collect())
    rows = drift.collect()
    assert len(rows) == 2
    assert all(not (r.method_changed or r.label_changed or r.confidence_changed or r.lost_chunks or r.gained_chunks) for r in rows)


def test_gold_evaluation_and_calibration(spark, corpus):
    chunk = corpus.chunks.filter("headings_path = 'Storage'").first().chunk_id
    gold = spark.createDataFrame(
        [(1, "ledger in a parquet table", "supported", [chunk], 1), (2, "dragons breathe fire", "not_found", None, 3)],
        "claim_id long, claim string, expected_label string, relevant_chunk_ids array<string>, corpus_version long",
    )
    report = jobs.evaluate_gold(gold, corpus, current_version=3).first()
    assert (report.n, report.accuracy, report.supported_f1, report.retrieval_recall, report.stale_entries) == (2, 1.0, 1.0, 1.0, 1)
    policy = jobs.calibrate(gold, corpus).first()
    assert policy.achievable and policy.n == 2


def test_whole_passages_inside_the_snapshot(spark):
    rows = [(f"c{i:02d}", "e1", i, f"word{i} text", None, 2, 1) for i in range(60)] + [("a00", "e1", -1, "late text", None, 2, 9), ("b00", "e2", 0, "other text", None, 2, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, evidence_id string, seq int, text string, headings_path string, token_count int, corpus_version long")
    evidence = spark.createDataFrame([("e1", "one", "p"), ("e2", "two", "p")], "evidence_id string, title string, source_path string")
    corpus = R.Corpus(chunks, evidence, R.build_index(chunks))
    claims = spark.createDataFrame(
        [(1, "text", "binary", "e1", 1), (2, "text", "judgment", "e1", None), (3, "late text", "binary", None, 1)],
        "claim_id long, claim string, mode string, evidence_id string, as_of long",
    )
    found = jobs.find_candidates(claims, corpus, k=5, pool=8).collect()
    by = {i: sorted((r for r in found if r["claim_id"] == i), key=lambda r: r["rank"]) for i in (1, 2, 3)}
    assert [r["chunk_id"] for r in by[1]] == [f"c{i:02d}" for i in range(60)] and {r["candidates_considered"] for r in by[1]} == {60}
    assert [r["chunk_id"] for r in by[2]][:2] == ["a00", "c00"] and len(by[2]) == 61
    assert len(by[3]) == 5 and "a00" not in {r["chunk_id"] for r in by[3]} and {r["method"] for r in by[3]} == {"bm25"}


def test_splitter_travels_where_functions_were_used_before(spark):
    from pyspark import cloudpickle

    import __spark_entry__  # noqa: F401
    from vouchspark.plans import job_queries

    sums = spark.createDataFrame([(1, "1 + 1", "2")], "run_id long, expression string, result string")
    job_queries.V.recheck_calculations(sums).collect()
    four = cloudpickle.loads(cloudpickle.dumps(job_queries._four))
    assert four("A b. C d. E f. G h. I j.") == ["A b.", "C d.", "E f.", "G h. I j."]
