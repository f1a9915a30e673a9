import random

import pytest
from pyspark.sql import functions as F

from vouchspark.operators import evaluate as E


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "confidence double, correct boolean")


def test_bins_and_error(spark):
    bins = E.reliability(results(spark, (0.95, True), (0.92, False), (0.55, True), (0.51, True))).orderBy("bin").collect()
    assert [(b["count"], round(b.mean_confidence, 3), b.accuracy) for b in bins] == [(2, 0.53, 1.0), (2, 0.935, 0.5)]
    over = results(spark, (1.0, True), (1.0, True), (1.0, False), (1.0, False))
    assert E.ece(E.reliability(over)).first()[0] == 0.5
    assert E.ece(E.reliability(results(spark, (1.0, True)))).first()[0] == 0.0
    assert E.ece(E.reliability(over.limit(0))).first()[0] == 0.0


def test_edges_fall_where_floating_point_puts_them(spark):
    df = results(spark, *[(i / 10, True) for i in range(11)], (-0.1, True), (1.01, True))
    got = {r.confidence: r.b for r in df.select("confidence", E.bin_number(F.col("confidence")).alias("b")).collect()}
    want = {i / 10: max(n for n, (lo, hi) in enumerate(E.bin_bounds()) if i / 10 >= lo) for i in range(11)}
    assert got == {**want, -0.1: None, 1.01: None} and got[0.3] == 2


def test_sweep(spark):
    row = E.sweep(results(spark, (0.99, True), (0.98, True), (0.80, True), (0.79, False))).first()
    assert (row.achievable, row.threshold, row.escalation_rate, row.accepted_accuracy, row.n) == (True, 0.8, 0.25, 1.0, 4)
    row = E.sweep(results(spark, (0.99, False), (0.98, True))).first()
    assert (row.achievable, row.threshold, row.max_accuracy, row.accepted_accuracy) == (False, 0.98, 0.5, 0.5)
    row = E.sweep(results(spark, (0.99, False), (0.98, False))).first()
    assert (row.achievable, row.threshold, row.escalation_rate) == (False, 0.99, 0.5)
    assert tuple(E.sweep(results(spark, (0.9, True)).limit(0)).first()) == (False, 1.0, 0.0, 0.0, 0.0, 0)


def test_sweep_equals_brute_force_with_a_hot_value(spark):
    rng = random.Random(3)
    rows = [(0.9 if rng.random() < 0.4 else round(rng.random(), 6), rng.random() < 0.7) for _ in range(1500)]
    row = E.sweep(results(spark, *rows), 0.72).first()
    best, meeting = (0.0, None), None
    for t in sorted({c for c, _ in rows}):
        kept = [ok for c, ok in rows if c >= t]
        accuracy = sum(kept) / len(kept)
        best = (accuracy, t) if accuracy > best[0] else best
        meeting = meeting or ((t, accuracy) if accuracy >= 0.72 else None)
    assert (row.threshold, row.accepted_accuracy, row.max_accuracy) == (*meeting, best[0])


def test_scores(spark):
    df = spark.createDataFrame(
        [("supported", "supported"), ("supported", "not_found"), ("not_found", "not_found"), ("not_found", "supported"), (None, "supported")], "predicted string, expected string"
    )
    assert tuple(E.confusion(df, "supported").first()) == (1, 1, 1, 1)
    row = E.scores(spark.createDataFrame([(3, 1, 4, 2)], "tp long, fp long, tn long, fn long")).first()
    assert (row.accuracy, row.precision, round(row.recall, 4), round(row.f1, 4)) == (0.7, 0.75, 0.6, 0.6667)
    assert E.scores(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, tn long, fn long")).first().f1 == 0.0


def test_recall(spark):
    gold = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, [])], "claim_id long, relevant_chunk_ids array<string>")
    hits = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x")], "claim_id long, chunk_id string")
    assert {r.claim_id: r.recall for r in E.recall_at_k(hits, gold).collect()} == {1: 0.5, 2: None, 3: None}


def test_gold_labels_are_checked(spark):
    df = spark.createDataFrame([("g", "t", "supported"), ("h", "s", "wrong")], "gold_id string, added_at string, expected_label string")
    with pytest.raises(Exception, match="four labels"):
        E.validate_gold(df).collect()
    assert [r.gold_id for r in E.validate_gold(df, strict=False).collect()] == ["g"]


def test_report_is_stored_and_read_back(spark, tmp_path):
    gold = spark.createDataFrame([(1, "supported", ["a"], 1), (2, "not_found", None, 1)], "claim_id long, expected_label string, relevant_chunk_ids array<string>, corpus_version long")
    verdicts = spark.createDataFrame([(1, "supported", 0.8), (2, "supported", 0.5)], "claim_id long, label string, confidence double")
    hits = spark.createDataFrame([(1, "a")], "claim_id long, chunk_id string")
    report = E.run_eval(verdicts, gold, hits, current_version=2)
    E.save_eval(report, str(tmp_path), eval_id="e1", workspace="w", created_at="now", config={"mode": "evidence", "k": 10})
    row = E.load_eval(spark, str(tmp_path), "e1").first()
    assert (row.n, row.accuracy, row.supported_precision, row.supported_recall) == (2, 0.5, 0.5, 1.0)
    assert round(row.calibration_ece, 6) == 0.35 and len(row.reliability) == 2
    assert (row.retrieval_recall, row.n_retrieval_labeled, row.stale_entries) == (1.0, 1, 1)
    assert E.load_eval(spark, str(tmp_path), "none").count() == 0


def test_sample_takes_the_same_rows_again(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("cell"), "id")
    pick = lambda seed: sorted(r.id for r in E.stratified(df.repartition(5), ["cell"], 10, seed).collect())
    assert len(pick(1)) == 30 and pick(1) == pick(1) != pick(2)


def test_policy_log(spark, tmp_path):
    for at, threshold in (("2024-01-01", 0.5), ("2024-02-01", 0.7)):
        row = [("w", threshold, at)]
        E.save_policy(spark.createDataFrame(row, "workspace string, escalation_threshold double, calibrated_at string"), str(tmp_path))
    assert E.latest_policy(spark.read.parquet(str(tmp_path))).first().escalation_threshold == 0.7
