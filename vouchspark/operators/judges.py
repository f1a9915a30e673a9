"""Scoring claims against their retrieved chunks: request tables and pluggable judges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchspark.functions.text import escape_markup, query_terms, strip_blanks, terms

# The answer given without asking a judge.
EMPTY_LABEL, EMPTY_CONFIDENCE = "not_found", 1.0
EMPTY_REASONING = "Corpus contains no chunks matching the claim's terms."
EMPTY_MISSING = "Any evidence relevant to the claim."


def corpus_block(hits: DataFrame, key: str = "claim_id") -> DataFrame:
    """One text per claim with its chunks in chunk-id order, byte-stable across runs.

    ``hits`` has at most k rows per claim, so the gathered list is bounded by k."""
    title = escape_markup(F.coalesce("evidence_title", F.lit("")))
    headings = escape_markup(F.coalesce("headings_path", F.lit("")))
    opening = F.concat(
        F.lit('<chunk id="'), "chunk_id", F.lit('" source="'), title, F.lit('" headings="'), headings, F.lit('">')
    )
    piece = F.concat_ws("\n", opening, strip_blanks(F.col("text")), F.lit("</chunk>"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", piece.alias("piece"))))
    pieces = F.transform(ordered, lambda p: p["piece"])
    body = F.array_join(F.concat(F.array(F.lit("<corpus>")), pieces, F.array(F.lit("</corpus>"))), "\n")
    return hits.groupBy(key).agg(body.alias("corpus"))


JudgeFn = Callable[[pd.DataFrame], pd.DataFrame]


def judge(requests: DataFrame, judge_fn: JudgeFn, schema: T.StructType | str, parallelism: int | None = None) -> DataFrame:
    """Run a plugged-in judge over requests, one Arrow batch per call.

    ``parallelism`` bounds how many calls run at the same time; requests are spread by
    claim, so a retry repeats the same batch."""
    if parallelism is not None:
        requests = requests.repartition(parallelism, requests.columns[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield judge_fn(frame)

    return requests.mapInPandas(run, schema)


def empty_verdicts(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Claims without a single hit: not found with full confidence, no judge asked."""
    silent = claims.join(hits.select("claim_id").distinct(), "claim_id", "left_anti")
    none = F.array().cast("array<string>")
    return silent.select(
        "claim_id",
        F.lit(EMPTY_LABEL).alias("label"),
        F.lit(EMPTY_CONFIDENCE).alias("confidence"),
        F.lit(EMPTY_REASONING).alias("reasoning"),
        none.alias("supporting_chunk_ids"),
        none.alias("contradicting_chunk_ids"),
        F.lit(EMPTY_MISSING).alias("missing_information"),
    )


def recorded_judge(claims: DataFrame, recorded: DataFrame) -> DataFrame:
    """Verdicts taken from a table of earlier answers."""
    return claims.select("claim_id").join(recorded, "claim_id")


SUPPORTED_SHARE, PARTIAL_SHARE = 0.5, 0.25
SHARE_DIGITS = 6


def overlap(claim: Column, text: Column) -> Column:
    """Share of the claim's distinct terms that occur in the text."""
    wanted, found = F.array_distinct(query_terms(claim)), F.array_distinct(terms(text))
    shared = F.size(F.array_intersect(wanted, found)) / F.greatest(F.size(wanted), F.lit(1))
    return F.round(shared, SHARE_DIGITS)


def lexical_judge(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Baseline without a model: the best overlap of a claim with one of its chunks.

    ``hits`` carries the chunk text.  Half of the terms in one chunk count as support,
    a quarter as partial support; confidence is the overlap itself."""
    shares = hits.join(claims.select("claim_id", "claim"), "claim_id").select(
        "claim_id", "chunk_id", overlap(F.col("claim"), F.col("text")).alias("share")
    )
    backing = F.array_sort(F.collect_list(F.when(F.col("share") >= PARTIAL_SHARE, F.col("chunk_id"))))
    best = shares.groupBy("claim_id").agg(F.max("share").alias("confidence"), backing.alias("supporting_chunk_ids"))
    label = F.when(F.col("confidence") >= SUPPORTED_SHARE, "supported").when(F.col("confidence") >= PARTIAL_SHARE, "partial")
    return best.select(
        "claim_id",
        label.otherwise("not_found").alias("label"),
        "confidence",
        F.concat(F.lit("Best term overlap "), F.format_string("%.6f", "confidence"), F.lit(".")).alias("reasoning"),
        "supporting_chunk_ids",
        F.array().cast("array<string>").alias("contradicting_chunk_ids"),
        F.lit(None).cast("string").alias("missing_information"),
    )
