"""Incremental corpus and index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vouchspark.operators import corpus as C
from vouchspark.operators import retrieval as R
from vouchspark.streaming import history as H
from vouchspark.streaming.tables import compact_table, read_table, run_batches, write_batch

EVIDENCE = "doc_id long, evidence_id string, sha256 string, source string, corpus_version long"
QUARANTINE = "doc_id long, source string"
CHUNKS = (
    "chunk_id string, evidence_id string, sha256 string, source string, corpus_version long, doc_id long, seq int, "
    "text string, token_count int, headings_path string, start_offset int, end_offset int"
)


def ingest_batch(batch: DataFrame, number: int, root: str, *, target: int, overlap: int, buckets: int = H.BUCKETS) -> None:
    """New documents of one micro-batch as evidence and chunks.

    Copies are dropped against the whole history; of its hashes only the buckets are read that a
    Bloom filter cannot rule out.  Versions go on from the last one.  Documents without a text go to
    the quarantine table."""
    spark = batch.sparkSession
    write_batch(C.quarantined(batch).select("doc_id", "source"), root, "quarantine", number)
    hashed = C.with_sha256(batch)
    history = H.known_hashes(spark, root, hashed, number, buckets)
    new = C.stamp_versions(C.with_evidence_id(C.new_evidence(hashed, history)), H.last_version(spark, root, number))
    write_batch(new.select("doc_id", "evidence_id", "sha256", "source", "corpus_version", "text"), root, "documents", number)
    # Chunks are cut from the written rows, so both tables agree whatever is recomputed.
    stored = spark.read.parquet(f"{root}/documents/batch={number}")
    write_batch(stored.drop("text"), root, "evidence", number)
    H.remember(stored, root, number, buckets)
    write_batch(C.chunk_documents(stored, target=target, overlap=overlap), root, "chunks", number)


def stream_ingest(
    source: DataFrame, root: str, *, target: int = C.TARGET_TOKENS, overlap: int = C.OVERLAP_TOKENS, buckets: int = H.BUCKETS, once: bool = True
) -> StreamingQuery:
    """Stream of documents (doc_id, text, source) into the tables below ``root``.  ``buckets`` splits the
    history of hashes and must stay the same for a root."""
    each = lambda batch, number: ingest_batch(batch, number, root, target=target, overlap=overlap, buckets=buckets)
    return run_batches(source, each, f"{root}/_progress/ingest", once=once)


def compact_corpus(spark: SparkSession, root: str) -> dict[str, int | None]:
    """Compact the tables of an ingest stream between its runs: the last batch taken in, by table."""
    tables = {"evidence": (EVIDENCE, None), "quarantine": (QUARANTINE, None), "chunks": (CHUNKS, None), "hashes": (H.HASHES, ["bucket"]), "filters": (H.FILTERS, None), "versions": (H.VERSIONS, None)}
    return {name: compact_table(spark, root, name, schema, by) for name, (schema, by) in tables.items()}


def evidence_table(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "evidence", EVIDENCE)


def quarantine_table(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "quarantine", QUARANTINE)


def chunk_table(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "chunks", CHUNKS)


def stream_index(chunks: DataFrame, root: str, *, buckets: int = 256, stem: bool = False, once: bool = True) -> StreamingQuery:
    """Stream of chunks into a stored index: postings and totals are appended per batch;
    document frequencies and averages are aggregated when a query is asked."""

    def each(batch: DataFrame, number: int) -> None:
        R.write_index(R.build_index(batch, stem=stem), root, buckets=buckets, batch=number)

    return run_batches(chunks, each, f"{root}/_progress/index", once=once)
