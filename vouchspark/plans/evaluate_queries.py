"""Queries over evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchspark.functions.text import yes_no
from vouchspark.operators import evaluate as E
from vouchspark.operators import verify as V
from vouchspark.plans import derived as D
from vouchspark.plans.registry import query

METRICS = ("accuracy", "precision", "recall", "f1")


def rounded(df, *columns, digits=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


def _gold_rows(spark, sf):
    labels = D.load(spark, sf, "labels")
    bad = F.when(F.col("doc_id") % 11 == 0, "unsure").when(F.col("quality") == 1, "supported").otherwise("not_found")
    return labels.select(
        F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("gold_id"), F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")).alias("added_at"),
        bad.alias("expected_label"), F.col("doc_id").alias("claim_id"),
    )


@query("""
    SELECT 'g' || doc_id AS gold_id, CASE WHEN quality = 1 THEN 'supported' ELSE 'not_found' END AS expected_label FROM labels WHERE doc_id % 11 <> 0""")
def valid_gold(spark, sf):
    """Gold claims with a known label."""
    return E.validate_gold(_gold_rows(spark, sf), strict=False).select("gold_id", "expected_label")


@query("""
    SELECT 'g' || doc_id AS gold_id, CASE WHEN doc_id % 11 = 0 THEN 'unknown expected_label: unsure' END AS error FROM labels""")
def gold_faults(spark, sf):
    """Every gold claim with what is wrong with its label."""
    return E.judged_gold(_gold_rows(spark, sf)).select("gold_id", "error")


@query("""
    SELECT doc_id, 'claim ' || doc_id AS claim, CASE WHEN quality = 1 THEN 'supported' ELSE 'not_found' END AS expected_label, 77 AS corpus_version,
           'import' AS source, CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id END AS relevant, 'n' || toxic AS note FROM labels""")
def imported_gold(spark, sf):
    """An imported gold set stamped with the current version."""
    none = F.array().cast("array<string>")
    rows = D.load(spark, sf, "labels").select(
        "doc_id", F.concat(F.lit("claim "), "doc_id").alias("text"), F.when(F.col("quality") == 1, "supported").otherwise("not_found").alias("expected"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("c"), "doc_id"))).otherwise(none).alias("relevant_chunk_ids"),
        F.concat(F.lit("n"), "toxic").alias("note"),
    )
    found = E.load_gold(rows, 77)
    return found.select("doc_id", "claim", "expected_label", "corpus_version", "source", F.array_join("relevant_chunk_ids", ",").alias("relevant"), "note")


@query("""
    SELECT run_id AS source_run_id, 'claim ' || run_id AS claim, CASE WHEN run_id % 2 = 0 THEN 'supported' ELSE 'partial' END AS expected_label, corpus_version, 'promoted' AS source
    FROM runs WHERE status = 'ok'""")
def promoted_gold(spark, sf):
    """Recorded runs promoted to gold claims."""
    traces = D.traces(spark, sf)
    labels = D.runs(spark, sf).filter(F.col("status") == "ok").select("run_id", F.when(F.col("run_id") % 2 == 0, "supported").otherwise("partial").alias("expected_label"))
    return E.promote(traces, labels)


@query("""
    SELECT count(*) FILTER (predicted = 'supported' AND expected = 'supported') AS tp, count(*) FILTER (predicted = 'supported' AND expected <> 'supported') AS fp,
           count(*) FILTER (predicted <> 'supported' AND expected <> 'supported') AS tn, count(*) FILTER (predicted <> 'supported' AND expected = 'supported') AS fn FROM pred""")
def confusion_counts(spark, sf):
    """Confusion counts; claims without a prediction are skipped."""
    return E.confusion(D.pred(spark, sf), "supported")


SCORES = """
    round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1"""


@query(f"SELECT source_ds, {SCORES} FROM cm")
def scores_by_source(spark, sf):
    """Accuracy, precision, recall and F1 per source."""
    return rounded(E.scores(E.confusion(D.pred_big(spark, sf), "supported", ["source_ds"])), *METRICS).select("source_ds", *METRICS)


@query(f"""
    SELECT source_ds, CAST(tp + fp + tn + fn AS BIGINT) AS n, {SCORES} FROM (
      SELECT * FROM cm UNION ALL SELECT NULL, sum(tp), sum(fp), sum(tn), sum(fn) FROM cm)""")
def source_breakdown(spark, sf):
    """E5: per source and overall."""
    return rounded(E.breakdown(D.pred_big(spark, sf), "supported"), *METRICS).select("source_ds", "n", *METRICS)


@query("""
    SELECT doc_id, CASE predicted WHEN 'supported' THEN 'PASS' WHEN 'not_found' THEN 'FAIL' END AS strict,
           CASE predicted WHEN 'supported' THEN 'yes' END AS other FROM pred""")
def mapped_labels(spark, sf):
    """Verdicts as PASS or FAIL, and under another mapping."""
    label = F.col("predicted")
    return D.pred(spark, sf).select("doc_id", E.map_labels(label).alias("strict"), E.map_labels(label, {"supported": "yes"}).alias("other"))


BOUNDS_SQL = "(VALUES " + ", ".join(f"({i}, CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE))" for i, (lo, hi) in enumerate(E.bin_bounds())) + ") b(bin, lo, hi)"
BINS_SQL = """
    SELECT bin, lo, hi, count(*) AS count, avg(confidence) AS mean_confidence, avg(CASE WHEN predicted = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
    FROM {table} p JOIN """ + BOUNDS_SQL + """ ON p.confidence >= b.lo AND (p.confidence < b.hi OR (b.hi = 1.0 AND p.confidence <= b.hi)) GROUP BY ALL"""


def _correct(df):
    return df.select("confidence", (F.col("predicted") == F.col("expected")).alias("correct"))


@query("SELECT bin, lo, hi, count, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM (" + BINS_SQL.format(table="pred_big") + ")")
def reliability_bins(spark, sf):
    """Confidence bins, values on the edges included."""
    return rounded(E.reliability(_correct(D.pred_big(spark, sf))), "mean_confidence", "accuracy")


@query("SELECT round(sum(count * abs(mean_confidence - accuracy)) / sum(count), 6) AS ece FROM (" + BINS_SQL.format(table="pred_big") + ")")
def calibration_error(spark, sf):
    """Expected calibration error."""
    return rounded(E.ece(E.reliability(_correct(D.pred_big(spark, sf)))), "ece")


def _sweep_sql(table, target):
    return f"""
    WITH v AS (SELECT confidence, count(*) AS r, count(*) FILTER (predicted = expected) AS k FROM {table} WHERE predicted IS NOT NULL GROUP BY 1),
    s AS (SELECT confidence AS t, sum(k) OVER w / CAST(sum(r) OVER w AS DOUBLE) AS acc, CAST(sum(r) OVER w AS DOUBLE) AS accepted, sum(r) OVER () AS n FROM v
          WINDOW w AS (ORDER BY confidence DESC)),
    m AS (SELECT * FROM s WHERE acc >= {target} ORDER BY t LIMIT 1),
    b AS (SELECT * FROM s ORDER BY acc DESC, t LIMIT 1),
    c AS (SELECT true AS achievable, * FROM m UNION ALL SELECT false, * FROM b WHERE NOT EXISTS (SELECT 1 FROM m))
    SELECT achievable, t AS threshold, round((n - accepted) / n, 6) AS escalation_rate, round(acc, 6) AS accepted_accuracy,
           round((SELECT max(acc) FROM s), 6) AS max_accuracy, CAST(n AS BIGINT) AS n FROM c"""


def _swept(df, target):
    return rounded(E.sweep(_correct(df.filter(F.col("predicted").isNotNull())), target), "escalation_rate", "accepted_accuracy", "max_accuracy")


@query(_sweep_sql("pred", "0.9::DOUBLE"))
def threshold_sweep(spark, sf):
    """Lowest threshold that reaches the target."""
    return _swept(D.pred(spark, sf), 0.9)


@query(_sweep_sql("pred_big", "0.99::DOUBLE"))
def threshold_out_of_reach(spark, sf):
    """No threshold reaches the target; the best one is reported."""
    return _swept(D.pred_big(spark, sf), 0.99)


@query("""
    SELECT confidence, count(*) AS n, count(*) FILTER ((predicted = 'supported') = (expected = 'supported')) AS right_answers FROM pred_big GROUP BY 1""")
def first_tier_results(spark, sf):
    """First-tier answers against gold."""
    found = E.tier1_results(D.pred_big(spark, sf))
    return found.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right_answers"))


RECALL_SQL = """
    recalls AS (SELECT g.claim_id, g.expected_label, g.corpus_version, CASE WHEN len(g.relevant) > 0 THEN
        CAST((SELECT count(DISTINCT h.chunk_id) FROM hits h WHERE h.claim_id = g.claim_id AND list_contains(g.relevant, h.chunk_id)) AS DOUBLE) / len(g.relevant) END AS recall
      FROM gold g)"""


@query(f"WITH {RECALL_SQL} SELECT claim_id, round(recall, 6) AS recall FROM recalls")
def retrieval_recall(spark, sf):
    """Share of the labelled chunks that were retrieved."""
    deep = D.recorded_hits(spark, sf, k=13)
    found = E.recall_at_k(deep.filter(F.col("rank") < D.TOP_K), D.gold(spark, sf, deep))
    return rounded(found, "recall")


@query("SELECT claim_id, corpus_version FROM gold WHERE len(relevant) > 0 AND corpus_version < 300")
def stale_gold(spark, sf):
    """Chunk labels of an older corpus."""
    return E.stale(D.gold(spark, sf), 300).select("claim_id", "corpus_version")


@query(f"""
    WITH {RECALL_SQL},
    j AS (SELECT r.*, v.final_label AS predicted, v.confidence, v.final_label = r.expected_label AS correct FROM recalls r JOIN guarded v ON v.claim_id = r.claim_id),
    c AS (SELECT count(*) FILTER (predicted = 'supported' AND expected_label = 'supported') AS tp, count(*) FILTER (predicted = 'supported' AND expected_label <> 'supported') AS fp,
                 count(*) FILTER (predicted <> 'supported' AND expected_label = 'supported') AS fn, count(*) AS n, count(*) FILTER (correct) AS k,
                 avg(recall) AS rec, count(recall) AS nl, count(*) FILTER (recall IS NOT NULL AND corpus_version < 300) AS stale FROM j),
    b AS (SELECT bin, count(*) AS n, avg(confidence) AS mc, avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM j JOIN {BOUNDS_SQL} ON confidence >= lo AND (confidence < hi OR (hi = 1.0 AND confidence <= hi)) GROUP BY 1)
    SELECT n, round(CAST(k AS DOUBLE) / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS supported_precision,
           round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS supported_recall,
           round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS supported_f1,
           (SELECT round(sum(n * abs(mc - a)) / sum(n), 6) FROM b) AS calibration_ece, (SELECT count(*) FROM b) AS bins,
           round(rec, 6) AS retrieval_recall, nl AS n_retrieval_labeled, stale AS stale_entries FROM c""")
def evaluation_report(spark, sf):
    """The report of an evaluation run."""
    deep = D.recorded_hits(spark, sf, k=13)
    hits = deep.filter(F.col("rank") < D.TOP_K)
    verdicts = V.guarded_verdicts(D.vd(spark, sf, hits).drop("candidates"), hits)
    report = E.run_eval(verdicts, D.gold(spark, sf, deep), hits, current_version=300)
    out = report.withColumn("bins", F.size("reliability").cast("long")).drop("reliability")
    return rounded(out, "accuracy", "supported_precision", "supported_recall", "supported_f1", "calibration_ece", "retrieval_recall")


@query("""
    SELECT workspace, escalation_threshold, calibrated_at FROM (SELECT 'ws' || (user_id % 9) AS workspace, round(value / 100, 4) AS escalation_threshold, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS calibrated_at FROM events)
    QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY calibrated_at DESC, escalation_threshold DESC) = 1""")
def current_policies(spark, sf):
    """The latest policy of every workspace from the log."""
    log = D.load(spark, sf, "events").select(
        F.concat(F.lit("ws"), (F.col("user_id") % 9).cast("string")).alias("workspace"), F.round(F.col("value") / 100, 4).alias("escalation_threshold"),
        D.iso(F.col("ts")).alias("calibrated_at"),
    )
    return E.latest_policy(log)


@query("""
    SELECT source_ds, expected, least(count(*), 42) AS n FROM pred_big GROUP BY ALL""")
def stratified_sample(spark, sf):
    """At most 42 rows per source and label (checked by their number)."""
    rows = D.load(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("source_ds"), F.when(F.col("l_partkey") % 3 == 0, "supported").otherwise("not_found").alias("expected"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
    )
    return E.stratified(rows, ["source_ds", "expected"]).groupBy("source_ds", "expected").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT count(*) AS n_cases, CAST(sum(len(fakes)) AS BIGINT) AS fakes_injected, CAST(sum(leaked) AS BIGINT) AS fakes_leaked,
           round(CAST(sum(leaked) AS DOUBLE) / sum(len(fakes)), 6) AS leak_rate, CAST(sum(len(s)) - sum(leaked) AS BIGINT) AS real_ids_passed FROM (
      SELECT fakes, s, len([x FOR x IN fakes IF list_contains(list_concat(s, c), x)]) AS leaked FROM (
        SELECT [fake1, fake2] AS fakes, list_concat(s, CASE WHEN claim_id % 10 = 0 THEN [fake1] ELSE [] END) AS s, c FROM guarded))""")
def citation_leaks(spark, sf):
    """Fake ids that survive; some are planted again behind the guard."""
    hits = D.recorded_hits(spark, sf)
    found = V.filter_citations(V.with_candidates(D.vd(spark, sf, hits).drop("candidates"), hits))
    fake1, fake2 = D.fake("fake", F.col("claim_id")), D.fake("other", F.col("claim_id"))
    again = F.when(F.col("claim_id") % 10 == 0, F.array(fake1)).otherwise(F.array().cast("array<string>"))
    cases = found.select(F.array(fake1, fake2).alias("fakes"), F.concat("supporting_chunk_ids", again).alias("supporting"), F.col("contradicting_chunk_ids").alias("contradicting"))
    return rounded(E.leak_rate(cases), "leak_rate")


@query(r"""
    SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^\s*YES\b') THEN 'PASS' WHEN regexp_matches(t, '^\s*NO\b') THEN 'FAIL'
        WHEN y = 0 AND n = 0 THEN '' WHEN y = 0 THEN 'FAIL' WHEN n = 0 THEN 'PASS' WHEN y < n THEN 'PASS' ELSE 'FAIL' END AS answer
    FROM (SELECT conv_id, turn, t, instr(t, 'YES') AS y, instr(t, 'NO') AS n FROM (
      SELECT conv_id, turn, upper(trim(CASE turn % 4 WHEN 0 THEN 'yes, ' || text WHEN 1 THEN 'No. ' || text WHEN 2 THEN text ELSE text || ' yes' END)) AS t FROM conversations))""")
def yes_no_answers(spark, sf):
    """Free text read as YES or NO."""
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("yes, "), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit("No. "), "text")).when(
        F.col("turn") % 4 == 2, F.col("text")
    ).otherwise(F.concat("text", F.lit(" yes")))
    return D.load(spark, sf, "conversations").select("conv_id", "turn", yes_no(said).alias("answer"))


@query("SELECT binary_label, count(*) AS n FROM (SELECT CASE WHEN value / 40 >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS binary_label FROM events) GROUP BY 1")
def binarized_scores(spark, sf):
    """An external judge's scores cut at one half."""
    return D.load(spark, sf, "events").select(E.binarize(F.col("value") / 40).alias("binary_label")).groupBy("binary_label").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT count(*) AS n, round(avg(CASE WHEN predicted = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate,
           avg(CASE WHEN predicted = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.8 AS passed FROM pred""")
def golden_pass_rate(spark, sf):
    """Share of golden claims answered as expected."""
    return rounded(E.pass_rate(D.pred(spark, sf)), "rate")


@query("""
    SELECT "view", value, count(*) AS n, round(avg(r), 6) AS accuracy FROM (
      SELECT 'label' AS "view", predicted AS value, CASE WHEN predicted = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM pred_big
      UNION ALL SELECT 'confidence', printf('%.1f', confidence), CASE WHEN predicted = expected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM pred_big) GROUP BY ALL""")
def verdict_distribution(spark, sf):
    """Verdicts and accuracy per label and per confidence."""
    return rounded(E.verdict_profile(D.pred_big(spark, sf)), "accuracy")


@query("""
    WITH v AS (SELECT source_ds, 'routed' AS variant, predicted, expected FROM pred_big
               UNION ALL SELECT source_ds, 'plain', CASE WHEN confidence >= 0.5 THEN predicted ELSE 'not_found' END, expected FROM pred_big),
    f AS (SELECT source_ds, variant, 2.0::DOUBLE * count(*) FILTER (predicted = 'supported' AND expected = 'supported')
          / (2 * count(*) FILTER (predicted = 'supported' AND expected = 'supported') + count(*) FILTER ((predicted = 'supported') <> (expected = 'supported'))) AS f1 FROM v GROUP BY ALL),
    w AS (SELECT source_ds, max(f1) FILTER (variant = 'plain') AS p, max(f1) FILTER (variant = 'routed') AS r FROM f GROUP BY 1)
    SELECT source_ds, round(p, 6) AS plain, round(r, 6) AS routed, round(r - p, 6) AS delta_routed FROM w""")
def variant_comparison(spark, sf):
    """F1 per source and variant, and the gain over the base."""
    base = D.pred_big(spark, sf)
    plain = base.withColumn("predicted", F.when(F.col("confidence") >= 0.5, F.col("predicted")).otherwise("not_found"))
    both = base.withColumn("variant", F.lit("routed")).unionByName(plain.withColumn("variant", F.lit("plain")))
    return rounded(E.compare(both, "supported", "plain", ["routed"]), "plain", "routed", "delta_routed")


@query("SELECT count(*) FILTER (predicted IS NOT NULL) AS n_evaluated, count(*) FILTER (predicted IS NULL OR doc_id % 13 = 0) AS n_skipped FROM pred")
def evaluated_counts(spark, sf):
    """How many items were scored and how many were not."""
    rows = D.pred(spark, sf).select(
        "predicted", F.when(F.col("predicted").isNull(), "no answer").alias("error"), F.when(F.col("doc_id") % 13 == 0, "skipped").alias("reason")
    )
    return E.evaluated_and_skipped(rows, "predicted", "error", "reason")
