"""Verification of claims: routing, verdict parsing, the citation guard, votes, escalation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchspark import schemas
from vouchspark.functions.arithmetic import recalculated
from vouchspark.functions.ids import ID_PATTERN, REDACTED
from vouchspark.functions.text import redact_ids, strip_blanks
from vouchspark.operators import judges as J

# Which mode a product domain uses, then the benchmark source names.
DOMAIN_MODES = {
    "general": "evidence", "legal": "evidence", "clinical": "binary", "biomedical": "binary",
    "financial": "arithmetic", "numeric": "binary",
}
SOURCE_MODES = {
    "covidQA": "evidence", "RAGTruth": "evidence", "halueval": "judgment", "pubmedQA": "binary",
    "FinanceBench": "arithmetic", "DROP": "binary",
}
MODES = ("evidence", "judgment", "binary", "decomposed", "arithmetic", "tiered")
DEFAULT_MODE = "evidence"
GUARDED_MODES = ("evidence", "judgment")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def routed_mode(domain: Column, explicit: Column | None = None) -> Column:
    """Mode of a claim: an explicit one wins, then the domain; NULL for an unknown domain."""
    by_domain = F.try_element_at(_lookup({**SOURCE_MODES, **DOMAIN_MODES}), domain)
    routed = F.when(domain.isNull(), F.lit(DEFAULT_MODE)).otherwise(by_domain)
    return routed if explicit is None else F.coalesce(explicit, routed)


def route_modes(claims: DataFrame, *, strict: bool = True, explicit: str | None = None) -> DataFrame:
    """``mode`` per claim.  ``strict`` fails the job on an unknown domain; otherwise such
    claims carry ``route_error`` for a quarantine output."""
    mode = routed_mode(F.col("domain"), F.col(explicit) if explicit else None)
    routed = claims.withColumn("mode", mode)
    known = F.coalesce(F.col("mode").isin(*MODES), F.lit(False))
    problem = F.concat(F.lit("unknown domain or mode: "), F.coalesce("mode", "domain", F.lit("")))
    if strict:
        return routed.filter(F.assert_true(known, problem).isNull())
    return routed.withColumn("route_error", F.when(~known, problem))


# --- verdicts --------------------------------------------------------------------------------
def parse_verdicts(df: DataFrame, kind: str = "verdict", column: str = "answer") -> DataFrame:
    """Judge answers (JSON text) as columns, with ``parse_error`` naming the first fault.

    ``kind`` is ``verdict`` (label and citations) or ``binary`` (faithful or not)."""
    schema = schemas.BINARY_VERDICT if kind == "binary" else schemas.VERDICT
    parsed = df.withColumn("_v", F.from_json(column, schema))
    fields = F.json_object_keys(column)
    required = ["faithful", "confidence", "reasoning"] if kind == "binary" else [
        "label", "confidence", "reasoning", "supporting_chunk_ids", "contradicting_chunk_ids"
    ]
    absent = F.array_except(F.array(*[F.lit(x) for x in required]), F.coalesce(fields, F.array().cast("array<string>")))
    confidence = F.col("_v.confidence")
    error = (
        F.when(F.try_parse_json(column).isNull() | fields.isNull(), "not a JSON object")
        .when(F.size(absent) > 0, F.concat(F.lit("missing "), F.get(absent, F.lit(0))))
        .when(confidence.isNull() | ~confidence.between(0.0, 1.0), "confidence outside 0..1")
    )
    if kind != "binary":
        error = F.when(error.isNotNull(), error).when(
            F.col("_v.label").isNull() | ~F.col("_v.label").isin(*schemas.LABELS), "unknown label"
        )
    return parsed.withColumn("parse_error", error).select(
        *[c for c in df.columns if c != column], F.col("_v.*"), "parse_error"
    )


def map_binary(df: DataFrame) -> DataFrame:
    """A yes/no verdict in the four-label vocabulary: unfaithful means not found, a missing
    confidence counts as 1.0, and there are no citations."""
    none = F.array().cast("array<string>")
    return (
        df.withColumn("label", F.when(F.coalesce("faithful", F.lit(False)), "supported").otherwise("not_found"))
        .withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
        .withColumn("reasoning", F.coalesce("reasoning", F.lit("")))
        .withColumn("supporting_chunk_ids", none)
        .withColumn("contradicting_chunk_ids", none)
        .withColumn("missing_information", F.lit(""))
        .drop("faithful")
    )


def with_candidates(verdicts: DataFrame, hits: DataFrame) -> DataFrame:
    """Add the retrieved chunk ids of each claim in rank order (at most k per claim)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    per_claim = hits.groupBy("claim_id").agg(F.transform(ordered, lambda h: h["chunk_id"]).alias("candidates"))
    joined = verdicts.join(per_claim, "claim_id", "left")
    return joined.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def _cited(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def filter_citations(verdicts: DataFrame) -> DataFrame:
    """Keep cited ids that were retrieved, in the order cited; ``dropped_chunk_ids`` are
    the others, sorted.  Needs ``candidates``."""
    known = lambda x: F.array_contains("candidates", x)
    both = F.array_union(_cited("supporting_chunk_ids"), _cited("contradicting_chunk_ids"))
    return (
        verdicts.withColumn("dropped_chunk_ids", F.array_sort(F.array_except(both, F.col("candidates"))))
        .withColumn("supporting_chunk_ids", F.filter(_cited("supporting_chunk_ids"), known))
        .withColumn("contradicting_chunk_ids", F.filter(_cited("contradicting_chunk_ids"), known))
    )


def guard(verdicts: DataFrame) -> DataFrame:
    """A label that no surviving citation backs becomes ``not_found``.

    Applies to the citing modes only (all rows if there is no ``mode`` column); confidence
    and surviving citations stay.  ``label_downgraded`` marks the change."""
    no_support, no_contra = F.size("supporting_chunk_ids") == 0, F.size("contradicting_chunk_ids") == 0
    label = F.col("label")
    baseless = (
        ((label == "supported") & no_support)
        | ((label == "contradicted") & no_contra)
        | ((label == "partial") & no_support & no_contra)
    )
    if "mode" in verdicts.columns:
        baseless = baseless & F.col("mode").isin(*GUARDED_MODES)
    return verdicts.withColumn("label_downgraded", F.coalesce(baseless, F.lit(False))).withColumn(
        "label", F.when(F.col("label_downgraded"), "not_found").otherwise(label)
    )


def redact(text: Column, valid: Column) -> Column:
    return redact_ids(text, valid, ID_PATTERN, REDACTED)


def redact_verdicts(verdicts: DataFrame) -> DataFrame:
    """Id-shaped words in prose that were not retrieved become a marker."""
    out = verdicts.withColumn("reasoning", redact(F.coalesce("reasoning", F.lit("")), F.col("candidates")))
    missing = redact(F.coalesce("missing_information", F.lit("")), F.col("candidates"))
    return out.withColumn("missing_information", F.nullif(missing, F.lit("")))


def guarded_verdicts(verdicts: DataFrame, hits: DataFrame) -> DataFrame:
    """The whole guard: citation filter, downgrade, redaction."""
    return redact_verdicts(guard(filter_citations(with_candidates(verdicts, hits))))


def cited_chunks(verdicts: DataFrame, hits: DataFrame, role: str = "supporting") -> DataFrame:
    """Retrieved rows of the cited chunks, each once, in candidate rank order."""
    cited = verdicts.select("claim_id", F.explode(F.array_distinct(F.col(f"{role}_chunk_ids"))).alias("chunk_id"))
    return hits.join(cited, ["claim_id", "chunk_id"], "left_semi").withColumn("role", F.lit(role))


# --- decomposition, escalation -------------------------------------------------------------------
def vote(atoms: DataFrame) -> DataFrame:
    """Confidence-weighted vote over the atoms of a claim: one aggregate with partial sums,
    so a claim with very many atoms is no burden."""
    weight = F.coalesce("confidence", F.lit(0.5))
    signed = F.when(F.col("label") == "supported", weight).when(F.col("label") == "not_found", -weight).otherwise(0.0)
    tally = atoms.groupBy("claim_id").agg(
        F.round(F.sum(signed), 9).alias("score"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("atoms")
    )
    label = F.when(F.col("score") > 0, "supported").when(F.col("score") < 0, "not_found").otherwise("partial")
    return tally.withColumn("label", label).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


SENTENCE_END = r"(?<=[.!?])[ \t\r\n\f]+"
MAX_ATOMS = 4


def sentences(text: Column) -> Column:
    pieces = F.transform(F.split(text, SENTENCE_END), strip_blanks)
    return F.filter(pieces, lambda s: s != "")


DecomposeFn = Callable[[str], list[str]]


def decompose(claims: DataFrame, fn: DecomposeFn | None = None) -> DataFrame:
    """One row per atom (claim_id, atom_index, atom): at most four, the claim itself if
    there is nothing to split.  The built-in splitter takes sentences; what does not fit
    the first three is the fourth atom, so no text is lost."""
    claim = F.col("claim")
    if fn is None:
        found = sentences(claim)
        tail = F.array_join(F.slice(found, F.lit(MAX_ATOMS), F.greatest(F.size(found), F.lit(1))), " ")
        atoms = F.when(F.size(found) <= MAX_ATOMS, found).otherwise(F.concat(F.slice(found, 1, MAX_ATOMS - 1), F.array(tail)))
        atoms = F.when(F.size(atoms) > 0, atoms).otherwise(F.array(claim))
        return claims.select("claim_id", F.posexplode(atoms).alias("atom_index", "atom"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for claim_id, text in zip(frame["claim_id"], frame["claim"]):
                found = list(fn(text)) or [text]
                rows.extend((claim_id, i, atom) for i, atom in enumerate(found))
            yield pd.DataFrame(rows, columns=["claim_id", "atom_index", "atom"])

    kind = claims.schema["claim_id"].dataType.simpleString()
    return claims.select("claim_id", "claim").mapInPandas(run, f"claim_id {kind}, atom_index int, atom string")


DEFAULT_THRESHOLD = 0.9


def needs_second_tier(first: DataFrame, threshold: float | Column = DEFAULT_THRESHOLD) -> DataFrame:
    """Claims whose first verdict is not confident enough; only these are judged again."""
    return first.filter(F.col("confidence") < threshold)


def tiered(first: DataFrame, second: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """First-tier verdicts that are confident enough, second-tier verdicts for the rest,
    with ``tier`` and ``escalated``."""
    columns = ["claim_id", "label", "confidence"]
    kept = first.filter(F.col("confidence") >= threshold).select(*columns, F.lit(1).alias("tier"), F.lit(False).alias("escalated"))
    again = second.join(needs_second_tier(first, threshold).select("claim_id"), "claim_id", "left_semi")
    return kept.unionByName(again.select(*columns, F.lit(2).alias("tier"), F.lit(True).alias("escalated")))


def tiered_by_policy(first: DataFrame, second: DataFrame, policy: DataFrame) -> DataFrame:
    """The same with each workspace's calibrated threshold; 0.9 where there is none.
    ``first`` carries ``workspace``; ``policy`` has one row per workspace."""
    cut = F.coalesce("escalation_threshold", F.lit(DEFAULT_THRESHOLD))
    held = first.join(policy.select("workspace", "escalation_threshold"), "workspace", "left").withColumn("_cut", cut)
    columns = ["claim_id", "label", "confidence"]
    kept = held.filter(F.col("confidence") >= F.col("_cut")).select(*columns, F.lit(1).alias("tier"), F.lit(False).alias("escalated"))
    rest = held.filter(F.col("confidence") < F.col("_cut")).select("claim_id")
    again = second.join(rest, "claim_id", "left_semi")
    return kept.unionByName(again.select(*columns, F.lit(2).alias("tier"), F.lit(True).alias("escalated")))


def answered_atoms(atoms: DataFrame, votes: DataFrame, hits: DataFrame) -> DataFrame:
    """``atoms`` per claim: text, label and confidence in order, with ids that were not retrieved
    redacted from the text.  A claim has as many as its decomposition gave."""
    ids = hits.groupBy("claim_id").agg(F.collect_list("chunk_id").alias("candidates"))
    told = atoms.select("claim_id", "atom_id", "atom_index", "atom").join(votes.select("atom_id", "label", "confidence"), "atom_id").join(ids, "claim_id")
    clean = F.struct("atom_index", redact(F.col("atom"), F.col("candidates")).alias("atom"), "label", "confidence")
    return told.groupBy("claim_id").agg(F.array_sort(F.collect_list(clean)).alias("listed")).select("claim_id", F.transform("listed", lambda a: F.struct(a["atom"].alias("atom"), a["label"].alias("label"), a["confidence"].alias("confidence"))).alias("atom_verdicts"))


# --- extraction, synthesis, documents --------------------------------------------------------------
REQUEST_CHARS = 200_000
# Where a part may end; never at its own start.
PART_END, PART_BLANK = re.compile(SENTENCE_END), re.compile(r"(?<=[^ \t\r\n\f])[ \t\r\n\f]")
BUDGET_FACTORS = (1, 4, 16)

ExtractFn = Callable[[str, int], tuple[list[str], bool]]


def request_parts(text: str, size: int = REQUEST_CHARS) -> list[str]:
    """``text`` cut into parts of at most ``size`` characters that add up to it.  A part ends
    behind the last sentence end that fits, in a longer sentence behind the last blank, and in
    a longer word at the bound."""
    parts, start = [], 0
    while len(text) - start > size:
        # One character more shows a sentence that ends at the bound.
        window = text[start : start + size + 1]
        ends = [m.start() for m in PART_END.finditer(window)] or [m.start() for m in PART_BLANK.finditer(window)]
        cut = start + (ends[-1] if ends else size)
        parts.append(text[start:cut])
        start = cut
    return [*parts, text[start:]]


def extract_claims(docs: DataFrame, fn: ExtractFn | None = None, budget: int = 1024) -> DataFrame:
    """Claims per document: (doc_id, part, claim_index, claim, error).

    A blank document has none.  A plugged-in extractor returns (claims, truncated) for a
    text and a budget; a truncated answer is asked again with 4 and 16 times the budget,
    and if that is still cut the part yields one error row instead of a partial list.
    One request carries at most 200,000 characters; a longer document goes out in several
    parts, so its whole text is read.  Parts end at sentence ends (see ``request_parts``).
    """
    filled = docs.filter(strip_blanks(F.coalesce("text", F.lit(""))) != "")
    if fn is None:
        claims = filled.select("doc_id", F.lit(0).alias("part"), F.posexplode(sentences(F.col("text"))).alias("claim_index", "claim"))
        return claims.withColumn("error", F.lit(None).cast("string"))
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            requests = ((d, part, text) for d, whole in zip(frame["doc_id"], frame["text"]) for part, text in enumerate(request_parts(whole)))
            for doc_id, part, text in requests:
                for factor in BUDGET_FACTORS:
                    claims, truncated = fn(text, budget * factor)
                    if not truncated:
                        rows.extend((doc_id, part, i, claim, None) for i, claim in enumerate(claims))
                        break
                else:
                    rows.append((doc_id, part, None, None, f"truncated at budget {budget * BUDGET_FACTORS[-1]}"))
            out = pd.DataFrame(rows, columns=["doc_id", "part", "claim_index", "claim", "error"])
            yield out.astype({"claim_index": "Int32", "part": "int32"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return filled.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, part int, claim_index int, claim string, error string")


def filter_key_points(df: DataFrame) -> DataFrame:
    """Key points with at least one retrieved id, invalid ids removed, and all ids used,
    sorted.  Needs ``key_points`` (array of point and ids) and ``candidates``."""
    stripped = F.transform(
        "key_points",
        lambda p: F.struct(
            p["point"].alias("point"),
            F.filter(p["supporting_chunk_ids"], lambda x: F.array_contains("candidates", x)).alias("supporting_chunk_ids"),
        ),
    )
    kept = F.filter(stripped, lambda p: F.size(p["supporting_chunk_ids"]) > 0)
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("key_points", lambda p: p["supporting_chunk_ids"]))))
    return df.withColumn("key_points", kept).withColumn("supporting_chunk_ids", ids)


# The answer for a topic without evidence.
SILENT_SUMMARY = "Corpus is silent on this topic."
SILENT_GAPS = "All relevant evidence is missing."
TOPIC_K, TOPIC_POOL = 12, 60
SYNTHESIS = "topic_id {}, summary string, key_points array<struct<point:string,supporting_chunk_ids:array<string>>>, gaps string"


def research_topics(topics: DataFrame, hits: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Synthesis per topic from its hydrated hits (claim_id = topic id, best 12 of the pool
    of 60).  The plugged-in writer gets (topic_id, topic, corpus); topics without evidence
    get the fixed answer."""
    best = hits.filter(F.col("rank") < TOPIC_K)
    requests = topics.join(J.corpus_block(best).withColumnRenamed("claim_id", "topic_id"), "topic_id")
    kind = topics.schema["topic_id"].dataType.simpleString()
    written = J.judge(requests.select("topic_id", "topic", "corpus"), fn, SYNTHESIS.format(kind))
    ids = best.groupBy("claim_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("candidates"))
    checked = filter_key_points(written.join(ids.withColumnRenamed("claim_id", "topic_id"), "topic_id")).drop("candidates")
    silent = topics.join(best.select(F.col("claim_id").alias("topic_id")).distinct(), "topic_id", "left_anti")
    return checked.unionByName(
        silent.select(
            "topic_id",
            F.lit(SILENT_SUMMARY).alias("summary"),
            F.array().cast(checked.schema["key_points"].dataType).alias("key_points"),
            F.lit(SILENT_GAPS).alias("gaps"),
            F.array().cast("array<string>").alias("supporting_chunk_ids"),
        )
    )


def label_counts(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Verdicts per label, and per document if given."""
    return verdicts.groupBy(*(by or []), "label").agg(F.count(F.lit(1)).alias("claims"))


def recheck_calculations(calls: DataFrame) -> DataFrame:
    """Recorded calculator calls (run_id, expression, result) evaluated again, with
    ``agrees``.  ``calculation_faults`` gives the share per run."""
    again = calls.withColumn("recomputed", recalculated(F.col("expression")))
    return again.withColumn("agrees", F.col("result").eqNullSafe(F.col("recomputed")))


def calculation_faults(checked: DataFrame) -> DataFrame:
    return checked.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("agrees")).alias("disagreements"),
        F.avg(F.when(F.col("agrees"), 0.0).otherwise(1.0)).alias("mismatch_rate"),
    )


def tool_calls(traces: DataFrame) -> DataFrame:
    """Calculator calls of recorded runs, from their ``tool_call_*`` events."""
    events = traces.select("run_id", F.explode("events").alias("e")).filter(F.startswith("e.key", F.lit("tool_call_")))
    body = F.from_json("e.value", "tool string, input struct<expression:string>, result string")
    return events.select("run_id", body.alias("b")).filter(F.col("b.tool") == "calculate").select(
        "run_id", F.col("b.input.expression").alias("expression"), F.col("b.result").alias("result")
    )
