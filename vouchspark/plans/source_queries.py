"""Queries over files that are first written from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from vouchspark.operators import audit as U
from vouchspark.plans import derived as D
from vouchspark.plans.registry import query
from vouchspark.session import checkpoint_root
from vouchspark.sources import files as FS
from vouchspark.sources import traces as TS
from vouchspark.sources.corpus_source import open_path


def _root(spark) -> str:
    return f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}"


#: Where a document's file goes: some in folders and types that a scan must leave alone.
PLACE_SQL = """CASE doc_id % 20 WHEN 3 THEN '.git/' || doc_id || '.txt' WHEN 5 THEN source || '/node_modules/' || doc_id || '.md' WHEN 7 THEN source || '/' || doc_id || '.bin'
    WHEN 9 THEN source || '/deep/er/' || doc_id || '.md' WHEN 11 THEN doc_id || '.html' ELSE source || '/' || doc_id || '.txt' END"""
PLACED_SQL = f"SELECT doc_id, text, {PLACE_SQL} AS relative FROM documents"


def _written(spark, sf) -> str:
    """One file per document below a new folder, written by tasks."""
    root = _root(spark)
    placed = D.documents(spark, sf).select(F.expr(PLACE_SQL).alias("relative"), F.col("text").cast("binary").alias("content"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_path(root)
        for frame in frames:
            for relative, content in zip(frame["relative"], frame["content"], strict=True):
                path = f"{base}/{relative}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write(content or b"")
            yield pd.DataFrame({"n": [len(frame)]})

    placed.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return root


@query(f"""
    SELECT relative, CASE WHEN relative LIKE '%.bin' THEN 'application/octet-stream' WHEN relative LIKE '%.html' THEN 'text/html' WHEN relative LIKE '%.md' THEN 'text/markdown' ELSE 'text/plain' END AS mime_type,
           relative NOT LIKE '%.bin' AS admitted, strlen(text) AS length, CASE WHEN relative NOT LIKE '%.bin' THEN sha256(text) END AS text_hash
    FROM ({PLACED_SQL}) WHERE relative NOT LIKE '.git/%' AND relative NOT LIKE '%/node_modules/%'""")
def scanned_corpus(spark, sf):
    """A folder scan through the data source."""
    found = FS.scan_corpus(spark, _written(spark, sf))
    return found.select("relative", "mime_type", "admitted", "length", F.sha2("text", 256).alias("text_hash"))


@query(f"SELECT relative, sha256(text) AS sha256, strlen(text) AS length FROM ({PLACED_SQL})")
def file_manifest(spark, sf):
    """Hashes of all files of a folder, read piece by piece."""
    root = _written(spark, sf)
    return U.manifest(spark, root).select(FS.inside(F.col("path"), root).alias("relative"), "sha256", "length")


@query("""
    SELECT CAST(r.run_id AS VARCHAR) AS run_id, r.status, r.started_at, substr(r.started_at, 1, 4) AS year, substr(r.started_at, 6, 2) AS month, coalesce(c.n_calls, 0) AS n_calls,
           coalesce(c.total_input_tokens, 0) AS input_tokens
    FROM runs r LEFT JOIN rollup_calls c ON c.run_id = r.run_id""")
def stored_traces(spark, sf):
    """Traces written as JSON by year and month and read back with the fixed schema."""
    root = _root(spark)
    TS.write_traces(D.traces(spark, sf), root)
    path, calls = F.input_file_name(), F.greatest(F.coalesce(F.size("llm_calls"), F.lit(0)), F.lit(0))
    tokens = F.aggregate("llm_calls", F.lit(0).cast("long"), lambda total, c: total + F.coalesce(c["input_tokens"], F.lit(0)))
    return TS.read_traces(spark, root).select(
        "run_id", "status", "started_at", F.regexp_extract(path, "year=([0-9]+)", 1).alias("year"), F.regexp_extract(path, "month=([0-9]+)", 1).alias("month"),
        calls.cast("long").alias("n_calls"), F.coalesce(tokens, F.lit(0)).alias("input_tokens"),
    )


ITEMS_SQL = """SELECT 'i' || lpad(CAST(item_id AS VARCHAR), 8, '0') AS id, text AS passage, 'Q' || item_id AS question, CASE WHEN item_id % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS label,
    CASE WHEN item_id % 4 = 0 THEN 'halu' ELSE 'rag' END AS source_ds FROM benchmark"""


def _items(spark, sf) -> str:
    root, item = _root(spark), F.col("item_id")
    made = D.load(spark, sf, "benchmark").select(
        F.concat(F.lit("i"), F.lpad(item.cast("string"), 8, "0")).alias("id"), F.col("text").alias("passage"), F.concat(F.lit("Q"), item.cast("string")).alias("question"),
        F.when(item % 3 == 0, "PASS").otherwise("FAIL").alias("label"), F.when(item % 4 == 0, "halu").otherwise("rag").alias("source_ds"), F.lit("extra").alias("unread"),
    )
    made.write.json(root)
    return root


@query(f"SELECT id, sha256(passage) AS passage_hash, question, label, source_ds FROM ({ITEMS_SQL}) WHERE source_ds = 'rag'")
def stored_items(spark, sf):
    """Benchmark items of one source from JSON lines."""
    return TS.read_items(spark, _items(spark, sf), "rag").select("id", F.sha2("passage", 256).alias("passage_hash"), "question", "label", "source_ds")


@query(f"SELECT id, label FROM ({ITEMS_SQL}) ORDER BY id LIMIT 7")
def first_items(spark, sf):
    """A caller's first items by id."""
    return TS.read_items(spark, _items(spark, sf), n=7).select("id", "label")
