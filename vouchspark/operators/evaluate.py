"""Evaluation against gold labels: scores, calibration, recall, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchspark import schemas
from vouchspark.operators.scaling import first_rows, running_sums

# --- gold set ------------------------------------------------------------------------------


def validate_gold(df: DataFrame, *, strict: bool = True) -> DataFrame:
    """Gold claims with one of the four labels, ordered by (added_at, gold_id).  ``strict``
    fails the job on another label, otherwise such rows are left out; ``judged_gold`` returns them
    with what is wrong."""
    valid = F.coalesce(F.col("expected_label").isin(*schemas.LABELS), F.lit(False))
    if strict:
        valid = F.assert_true(valid, F.lit("expected_label must be one of the four labels")).isNull()
    return df.filter(valid).orderBy("added_at", "gold_id")


def judged_gold(df: DataFrame) -> DataFrame:
    """All rows with ``error``: NULL for a known label, else what is wrong.  Nothing is dropped."""
    label = F.col("expected_label")
    error = F.when(label.isNull(), "expected_label is missing").when(~label.isin(*schemas.LABELS), F.concat(F.lit("unknown expected_label: "), label))
    return df.withColumn("error", error)


def load_gold(df: DataFrame, corpus_version: int | Column) -> DataFrame:
    """Imported rows (text, expected, optional relevant_chunk_ids and note) as gold claims
    of the current corpus version."""
    empty = F.lit(None)
    have = set(df.columns)
    version = corpus_version if isinstance(corpus_version, Column) else F.lit(corpus_version)
    relevant = F.col("relevant_chunk_ids") if "relevant_chunk_ids" in have else empty.cast("array<string>")
    return df.withColumn("_relevant", relevant).select(
        *[c for c in df.columns if c not in ("text", "expected", "relevant_chunk_ids", "note")],
        F.col("text").alias("claim"),
        F.col("expected").alias("expected_label"),
        F.when(F.size("_relevant") > 0, F.col("_relevant")).alias("relevant_chunk_ids"),
        (F.col("note") if "note" in have else empty.cast("string")).alias("note"),
        version.cast("long").alias("corpus_version"),
        F.lit("import").alias("source"),
        F.lit(None).cast("string").alias("source_run_id"),
    )


def promote(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """Recorded runs turned into gold claims: claim from the inputs, else from the output;
    corpus version from the trace.  ``labels`` has run_id and expected_label."""
    claim = F.coalesce(F.try_element_at("inputs", F.lit("claim")), F.get_json_object("output", "$.claim"))
    return traces.join(labels, "run_id").select(
        F.col("run_id").alias("source_run_id"), claim.alias("claim"), "expected_label", "corpus_version",
        F.lit("promoted").alias("source"),
    )


def stale(gold: DataFrame, version: int | Column) -> DataFrame:
    """Gold claims whose chunk labels belong to an older corpus version."""
    limit = version if isinstance(version, Column) else F.lit(version)
    return gold.filter((F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))) > 0) & (F.col("corpus_version") < limit))


# --- confusion and scores ----------------------------------------------------------------------
COUNTS = ("tp", "fp", "tn", "fn")


def confusion_columns(positive: str, predicted: str = "predicted", expected: str = "expected") -> list[Column]:
    """Conditional counts; a NULL prediction is skipped, not counted as wrong."""
    p, e = F.col(predicted) == positive, F.col(expected) == positive
    return [
        F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"),
        F.count_if(~p & ~e).alias("tn"), F.count_if(~p & e).alias("fn"),
    ]


def confusion(df: DataFrame, positive: str, by: list[str] | None = None, **columns: str) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*confusion_columns(positive, **columns))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def scores(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 next to the counts; 0.0 on an empty denominator."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    out = (
        cm.withColumn("accuracy", _ratio(tp + tn, tp + fp + tn + fn))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2 * p * r, p + r))


def breakdown(df: DataFrame, positive: str, by: str = "source_ds", **columns: str) -> DataFrame:
    """Scores per source and overall (NULL source) from one pass: the rollup adds up the
    per-source counts, which are few, instead of expanding every row."""
    per_source = confusion(df.filter(F.col(columns.get("predicted", "predicted")).isNotNull()), positive, [by], **columns)
    both = per_source.rollup(by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return scores(both).withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))


# How verdict labels count in a PASS/FAIL benchmark.
PASS_FAIL = {"supported": "PASS", "partial": "FAIL", "contradicted": "FAIL", "not_found": "FAIL"}


def map_labels(label: Column, mapping: dict[str, str] | None = None) -> Column:
    table = mapping or PASS_FAIL
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), label)


def binarize(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score.isNotNull(), F.when(score >= threshold, "PASS").otherwise("FAIL"))


def evaluated_and_skipped(df: DataFrame, binary: str, error: str, reason: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(binary).isNotNull()).alias("n_evaluated"),
        F.count_if(F.col(error).isNotNull() | F.col(reason).isNotNull()).alias("n_skipped"),
    )


# --- calibration ----------------------------------------------------------------------------------
def bin_bounds(n_bins: int = 10) -> list[tuple[float, float]]:
    width = 1.0 / n_bins
    return [(i * width, 1.0 if i == n_bins - 1 else (i + 1) * width) for i in range(n_bins)]


def bin_number(confidence: Column, n_bins: int = 10) -> Column:
    """Equal bins with the very floating point bounds of ``bin_bounds``; the last is closed
    on the right; NULL outside 0..1.  Bounds are literals, so no join is needed."""
    lows = F.array(*[F.lit(lo) for lo, _ in bin_bounds(n_bins)])
    inside = (confidence >= 0.0) & (confidence <= 1.0)
    return F.when(inside, F.size(F.filter(lows, lambda lo: confidence >= lo)) - 1)


def reliability(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Per non-empty bin: lo, hi, count, mean confidence, accuracy."""
    bounds = bin_bounds(n_bins)
    lo, hi = (F.array(*[F.lit(b[i]) for b in bounds]) for i in (0, 1))
    binned = df.withColumn("bin", bin_number(F.col("confidence"), n_bins)).filter(F.col("bin").isNotNull())
    stats = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)).alias("accuracy"),
    )
    return stats.withColumn("lo", F.get(lo, "bin")).withColumn("hi", F.get(hi, "bin"))


def ece(bins: DataFrame) -> DataFrame:
    """Count-weighted mean gap between confidence and accuracy; 0.0 without any bin."""
    gap = F.sum(F.col("count") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("count")
    return bins.agg(F.coalesce(gap, F.lit(0.0)).alias("ece"))


def tier1_results(df: DataFrame) -> DataFrame:
    """A first-tier verdict is right when it agrees with gold on being supported or not."""
    right = (F.col("predicted") == "supported") == (F.col("expected") == "supported")
    return df.select("confidence", right.alias("correct"))


def sweep(df: DataFrame, target: float = 0.95) -> DataFrame:
    """Lowest confidence threshold whose accepted verdicts reach the target accuracy.

    One row: achievable, threshold, escalation_rate, accepted_accuracy, max_accuracy, n.
    Equal confidences are added up first; accepted counts are running sums from the top.
    """
    per_value = df.groupBy("confidence").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("correct").alias("right")
    )
    steps = running_sums(per_value, [F.col("confidence").desc()], {"accepted": "rows", "accepted_right": "right"})
    steps = steps.withColumn("accuracy", F.col("accepted_right") / F.col("accepted"))
    point = F.struct("confidence", "accuracy", "accepted")
    best = F.struct("accuracy", (-F.col("confidence")).alias("lowest_first"))
    found = steps.agg(
        F.sum("rows").alias("n"),
        F.min(F.when(F.col("accuracy") >= target, point)).alias("meeting"),
        F.max_by(point, F.when(F.col("accuracy") > 0, best)).alias("best"),
        F.max("accuracy").alias("max_accuracy"),
        F.max(point).alias("top"),
    )
    # Without any right verdict the highest threshold stays the best one.
    chosen = F.coalesce("meeting", "best", "top")
    escalated = (F.col("n") - F.col("chosen.accepted")) / F.col("n")
    return found.withColumn("chosen", chosen).select(
        F.col("meeting").isNotNull().alias("achievable"),
        F.coalesce("chosen.confidence", F.lit(1.0)).alias("threshold"),
        F.coalesce(escalated, F.lit(0.0)).alias("escalation_rate"),
        F.coalesce(F.when(F.col("meeting").isNotNull(), F.col("meeting.accuracy")).otherwise(F.col("max_accuracy")), F.lit(0.0)).alias("accepted_accuracy"),
        F.coalesce("max_accuracy", F.lit(0.0)).alias("max_accuracy"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def latest_policy(log: DataFrame) -> DataFrame:
    """One policy per workspace from the appended log, the latest wins.  An unachievable
    calibration is stored too."""
    fields = [c for c in log.columns if c != "workspace"]
    newest = F.max_by(F.struct(*fields), F.struct("calibrated_at", "escalation_threshold"))
    return log.groupBy("workspace").agg(newest.alias("p")).select("workspace", *[F.col(f"p.{c}").alias(c) for c in fields])


def save_policy(policy: DataFrame, path: str) -> None:
    policy.write.mode("append").parquet(path)


# --- recall, report -----------------------------------------------------------------------------------
def recall_at_k(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of relevant chunks retrieved per claim; NULL where none are labelled.  Hits are
    first cut to labelled chunks by a join, so long hit lists are never gathered."""
    labelled = gold.select("claim_id", F.explode("relevant_chunk_ids").alias("chunk_id")).distinct()
    found = labelled.join(hits.select("claim_id", "chunk_id").distinct(), ["claim_id", "chunk_id"], "left_semi")
    hit = found.groupBy("claim_id").agg(F.count(F.lit(1)).alias("hit"))
    wanted = F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>")))
    joined = gold.select("claim_id", wanted.alias("wanted")).join(hit, "claim_id", "left")
    return joined.select(
        "claim_id", F.when(F.col("wanted") > 0, F.coalesce("hit", F.lit(0)) / F.col("wanted")).alias("recall")
    )


def run_eval(
    verdicts: DataFrame, gold: DataFrame, hits: DataFrame, *, current_version: int, n_bins: int = 10
) -> DataFrame:
    """The whole report in one row.  Scores and all bins come from one aggregate, so the
    joined table is read once."""
    joined = gold.join(verdicts.select("claim_id", F.col("label").alias("predicted"), "confidence"), "claim_id").join(
        recall_at_k(hits, gold), "claim_id"
    )
    rows = joined.select(
        "predicted", F.col("expected_label").alias("expected"), "confidence", "recall",
        (F.col("predicted") == F.col("expected_label")).alias("correct"),
        bin_number(F.col("confidence"), n_bins).alias("bin"),
        (F.col("recall").isNotNull() & (F.col("corpus_version") < current_version)).alias("stale"),
    )
    per_bin = [
        F.struct(
            F.count_if(F.col("bin") == i).alias("count"),
            F.avg(F.when(F.col("bin") == i, F.col("confidence"))).alias("mean_confidence"),
            F.avg(F.when(F.col("bin") == i, F.col("correct").cast("double"))).alias("accuracy"),
        ).alias(f"bin{i}")
        for i in range(n_bins)
    ]
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"), *confusion_columns("supported"),
        F.avg("recall").alias("retrieval_recall"), F.count("recall").alias("n_retrieval_labeled"),
        F.count_if("stale").alias("stale_entries"), *per_bin,
    )
    bounds = bin_bounds(n_bins)
    bins = F.array(*[
        F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f"bin{i}.count").alias("count"),
                 F.col(f"bin{i}.mean_confidence").alias("mean_confidence"), F.col(f"bin{i}.accuracy").alias("accuracy"))
        for i, (lo, hi) in enumerate(bounds)
    ])
    scored = scores(totals).withColumn("reliability", F.filter(bins, lambda b: b["count"] > 0))
    gaps = F.aggregate(
        "reliability", F.lit(0.0), lambda acc, b: acc + b["count"] * F.abs(b["mean_confidence"] - b["accuracy"])
    )
    binned = F.aggregate("reliability", F.lit(0).cast("long"), lambda acc, b: acc + b["count"])
    return scored.select(
        "n", _ratio(F.col("right"), F.col("n")).alias("accuracy"),
        F.col("precision").alias("supported_precision"), F.col("recall").alias("supported_recall"), F.col("f1").alias("supported_f1"),
        _ratio(gaps, binned).alias("calibration_ece"), "reliability", "retrieval_recall", "n_retrieval_labeled", "stale_entries",
    )


def save_eval(report: DataFrame, path: str, *, eval_id: str, workspace: str, created_at: str, config: dict) -> None:
    """Append a report to the stored evaluations, metrics as JSON text."""
    settings = F.to_json(F.create_map(*[F.lit(str(x)) for pair in config.items() for x in pair]))
    report.select(
        F.lit(eval_id).alias("eval_id"), F.lit(workspace).alias("workspace"), F.lit(created_at).alias("created_at"),
        settings.alias("config_json"), F.to_json(F.struct("*")).alias("metrics_json"),
    ).write.mode("append").parquet(path)


REPORT = (
    "n long, accuracy double, supported_precision double, supported_recall double, supported_f1 double, "
    "calibration_ece double, reliability array<struct<lo:double,hi:double,count:long,mean_confidence:double,accuracy:double>>, "
    "retrieval_recall double, n_retrieval_labeled long, stale_entries long"
)


def load_eval(spark: SparkSession, path: str, eval_id: str) -> DataFrame:
    """A stored report by id."""
    stored = spark.read.schema(schemas.EVAL_RUN).parquet(path).filter(F.col("eval_id") == eval_id)
    return stored.select("eval_id", "workspace", F.from_json("metrics_json", REPORT).alias("m")).select("eval_id", "workspace", "m.*")


# --- samples and comparisons ------------------------------------------------------------------------------
def stratified(df: DataFrame, keys: list[str], per_cell: int = 42, seed: int = 42, id: str = "id") -> DataFrame:
    """At most ``per_cell`` rows of every cell, picked by a seeded hash of the id."""
    order = F.xxhash64(F.lit(seed), F.col(id))
    return first_rows(df, keys, [order, F.col(id)], per_cell, "_rn").drop("_rn")


def leak_rate(cases: DataFrame) -> DataFrame:
    """Injected fake ids that survived the guard, and real ids that passed.

    Cases carry ``fakes`` and the returned ``supporting`` and ``contradicting`` ids."""
    returned = F.array_union("supporting", "contradicting")
    leaked = F.size(F.array_intersect(F.array_distinct("fakes"), returned))
    totals = cases.agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum(F.size("fakes")).alias("fakes_injected"),
        F.sum(leaked).alias("fakes_leaked"), F.sum(F.size("supporting")).alias("_supporting"),
    )
    return totals.select(
        "n_cases", "fakes_injected", "fakes_leaked",
        _ratio(F.col("fakes_leaked"), F.col("fakes_injected")).alias("leak_rate"),
        (F.col("_supporting") - F.col("fakes_leaked")).alias("real_ids_passed"),
    )


def pass_rate(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Share of golden claims that matched, against a threshold."""
    rate = F.avg(F.when(F.col("predicted") == F.col("expected"), 1.0).otherwise(0.0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(rate, F.lit(0.0)).alias("rate")).withColumn(
        "passed", F.col("rate") >= threshold
    )


def verdict_profile(df: DataFrame) -> DataFrame:
    """Count and accuracy per label and per confidence rounded to one digit, in one pass."""
    right = F.when(F.col("predicted") == F.col("expected"), 1.0).otherwise(0.0)
    views = F.explode(
        F.array(
            F.struct(F.lit("label").alias("view"), F.col("predicted").alias("value")),
            F.struct(F.lit("confidence").alias("view"), F.format_string("%.1f", F.round("confidence", 1)).alias("value")),
        )
    )
    pairs = df.groupBy("predicted", F.round("confidence", 1).alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("right")
    )
    return (
        pairs.select(views.alias("v"), "n", "right").groupBy("v.view", "v.value")
        .agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"))
    )


def compare(df: DataFrame, positive: str, base: str, variants: list[str], by: str = "source_ds") -> DataFrame:
    """F1 per source and variant, and the difference to the base variant."""
    per_variant = scores(confusion(df, positive, [by, "variant"])).select(by, "variant", "f1")
    wide = per_variant.groupBy(by).pivot("variant", [base, *variants]).agg(F.first("f1"))
    deltas = [(F.col(v) - F.col(base)).alias(f"delta_{v}") for v in variants]
    return wide.select(by, base, *variants, *deltas)
