"""Queries over sources and corpus building."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchspark.functions.text import first_title
from vouchspark.operators import corpus as C
from vouchspark.plans import derived as D
from vouchspark.plans.registry import query
from vouchspark.sources import audit_tables as A
from vouchspark.sources import documents as S
from vouchspark.sources import files as FS


@query("""
    SELECT doc_id, length(text) AS n_chars, source || '/' || doc_id AS source_path, 'text/plain' AS mime_type FROM documents""")
def document_source(spark, sf):
    """A table of texts as evidence."""
    docs = S.from_documents(D.load(spark, sf, "documents"), id="doc_id", text="text", source="source")
    return docs.select("doc_id", F.length("text").alias("n_chars"), "source_path", "mime_type")


URL_PARTS = r"""
    SELECT page_id, body, mime_type, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority FROM bad_urls"""


@query(rf"""
    WITH parts AS ({URL_PARTS}),
    hosts AS (SELECT *, lower(CASE WHEN p LIKE '[%' THEN regexp_extract(p, '^\[([^\]]*)\]', 1)
                              ELSE regexp_extract(p, '^([^:]*)', 1) END) AS host
              FROM (SELECT *, regexp_replace(authority, '^.*@', '') AS p FROM parts)),
    judged AS (SELECT page_id, CASE
        WHEN scheme NOT IN ('http', 'https') THEN 'scheme'
        WHEN authority LIKE '%@%' THEN 'credentials'
        WHEN host = '' THEN 'no host'
        WHEN host LIKE '10.%' OR host LIKE '169.254.%' OR host = '::1' OR host LIKE '100.64.%' THEN 'non-public address'
        WHEN strlen(body) > 26214400 THEN 'too large'
        WHEN mime_type NOT LIKE 'text/%' AND mime_type <> 'application/pdf' THEN 'unsupported type' END AS reason FROM hosts)
    SELECT page_id, reason, reason IS NULL AS admitted FROM judged""")
def page_admission(spark, sf):
    """Which fetched pages may become evidence, and why not."""
    return S.admit_pages(D.bad_urls(spark, sf)).select("page_id", "reason", "admitted")


@query("""
    SELECT path, mime_type, mime_type LIKE 'text/%' OR mime_type IN ('application/json', 'application/pdf') AS admitted FROM (
      SELECT source_path || x.ext AS path, x.mime AS mime_type FROM ev, (VALUES ('', 'text/plain'), ('.md', 'text/markdown'),
        ('.json', 'application/json'), ('.pdf', 'application/pdf'), ('.png', 'image/png'), ('.unknownext', 'application/octet-stream')) x(ext, mime))""")
def mime_typing(spark, sf):
    """Type and admission by extension."""
    extension = F.explode(F.array(*[F.lit(e) for e in ("", ".md", ".json", ".pdf", ".png", ".unknownext")]))
    paths = D.unversioned(spark, sf).select("source_path", extension.alias("ext"))
    return FS.with_mime(paths.select(F.concat("source_path", "ext").alias("path")))


@query(r"""
    SELECT doc_id, length(text) + 2 AS n_chars FROM documents""")
def text_decoding(spark, sf):
    """S3: broken bytes become one replacement character each; the rest is untouched."""
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")), F.lit("z").cast("binary"))
    return D.load(spark, sf, "documents").select("doc_id", F.length(FS.decode_text(raw)).cast("long").alias("n_chars"))


@query("""
    SELECT run_id, started_at, workspace FROM runs WHERE started_at >= '1998-01-01' AND started_at <= '1998-12-31'""")
def audit_period_runs(spark, sf):
    """Runs of a period, bounds compared as text."""
    kept, _ = A.audit_slice(D.runs(spark, sf), _approval_times(spark, sf), "1998-01-01", "1998-12-31")
    return kept.select("run_id", "started_at", "workspace")


def _approval_times(spark, sf):
    bought = D.load(spark, sf, "events").filter(F.col("event_type") == "purchase")
    return bought.select(F.col("event_id").alias("approval_id"), D.iso(F.col("ts")).alias("created_at"))


@query("""
    SELECT approval_id, created_at FROM proposals WHERE created_at >= '2024-01-03' AND created_at <= '2024-01-10'""")
def audit_period_approvals(spark, sf):
    """Approvals of a period."""
    _, kept = A.audit_slice(D.runs(spark, sf), _approval_times(spark, sf), "2024-01-03", "2024-01-10")
    return kept.select("approval_id", "created_at")


@query("""
    SELECT 'run' AS kind, CAST(run_id AS VARCHAR) AS id, started_at, NULL AS created_at, workspace FROM runs
    UNION ALL SELECT 'approval', CAST(approval_id AS VARCHAR), NULL, created_at, NULL FROM proposals""")
def audit_column_union(spark, sf):
    """One stream over the union of columns, missing ones empty."""
    runs = D.runs(spark, sf).select(F.lit("run").alias("kind"), F.col("run_id").cast("string").alias("id"), "started_at", "workspace")
    approvals = _approval_times(spark, sf).select(F.lit("approval").alias("kind"), F.col("approval_id").cast("string").alias("id"), "created_at")
    return A.union_columns([runs, approvals])


# --- corpus --------------------------------------------------------------------------------
@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf):
    """Fingerprint of every document."""
    return C.with_sha256(D.load(spark, sf, "documents")).select("doc_id", "sha256")


@query("SELECT evidence_id, sha256, doc_id, source FROM ev")
def new_documents(spark, sf):
    """First copy of every content."""
    return D.unversioned(spark, sf).select("evidence_id", "sha256", "doc_id", "source")


@query("""
    SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0
      AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 2""")
def second_batch(spark, sf):
    """A batch against evidence already held."""
    docs = D.documents(spark, sf)
    held = C.with_sha256(docs.filter(F.col("doc_id") % 3 == 0)).select("sha256")
    return C.new_evidence(docs.filter(F.col("doc_id") % 3 != 0), held).select("doc_id", "sha256")


@query("SELECT doc_id, evidence_id, corpus_version FROM ev")
def corpus_versions(spark, sf):
    """One version step per new document, in ingest order."""
    return D.ev(spark, sf).select("doc_id", "evidence_id", "corpus_version")


MARKDOWN_SQL = """
    SELECT doc_id, '# T' || doc_id || chr(10) || text || chr(10) || '## S' || chr(10) || text AS text, text AS raw FROM documents"""


def _markdown(spark, sf):
    docs = D.documents(spark, sf)
    body = F.concat(F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n## S\n"), "text")
    return C.with_sha256(docs.select("doc_id", F.col("text").alias("raw"), body.alias("text")))


@query(f"""
    SELECT doc_id, 'T' || doc_id AS with_heading, 'doc' || doc_id AS without_heading, 'T' || doc_id AS after_tabs FROM ({MARKDOWN_SQL})""")
def titles(spark, sf):
    """C4: title line or fallback."""
    fallback = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return _markdown(spark, sf).select(
        "doc_id", first_title(F.col("text"), fallback).alias("with_heading"), first_title(F.col("raw"), fallback).alias("without_heading"),
        first_title(F.concat(F.lit("\t"), F.regexp_replace("text", "\n## S", "\t\n## S")), fallback).alias("after_tabs"),
    )


@query(f"""
    SELECT doc_id, 0 AS section_start, length('# T' || doc_id || chr(10) || raw || chr(10)) AS section_end, 'T' || doc_id AS headings_path FROM ({MARKDOWN_SQL})
    UNION ALL
    SELECT doc_id, length('# T' || doc_id || chr(10) || raw || chr(10)), length(text), 'T' || doc_id || ' > S' FROM ({MARKDOWN_SQL})""")
def heading_sections(spark, sf):
    """Sections of marked-up documents with their heading path."""
    found = C.split_sections(_markdown(spark, sf).drop("raw"))
    return found.select("doc_id", F.col("section_start").cast("long"), F.col("section_end").cast("long"), "headings_path")


@query("""
    SELECT chunk_id, evidence_id, seq, sha256(text) AS text_hash, token_count, start_offset, start_offset + length(text) AS end_offset FROM ch""")
def word_chunks(spark, sf):
    """Token windows with exact character offsets, numbered per document."""
    return D.ch(spark, sf).select(
        "chunk_id", "evidence_id", F.col("seq").cast("long"), F.sha2("text", 256).alias("text_hash"),
        F.col("token_count").cast("long"), F.col("start_offset").cast("long"), F.col("end_offset").cast("long"),
    )


@query("""
    SELECT c.chunk_id, c.text = substr(e.text, c.start_offset + 1, length(c.text)) AS exact FROM ch c JOIN ev e ON e.evidence_id = c.evidence_id""")
def chunk_slices(spark, sf):
    """Every chunk is the exact slice of its document."""
    docs = D.unversioned(spark, sf).select("evidence_id", F.col("text").alias("body"))
    joined = D.ch(spark, sf).join(docs, "evidence_id")
    cut = F.substr("body", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return joined.select("chunk_id", (F.col("text") == cut).alias("exact"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}]|[^ \t\r\n\f\p{Han}\p{Hiragana}\p{Katakana}]{1,64}')) AS tokens FROM documents")
def token_counts(spark, sf):
    """Words per document."""
    return D.load(spark, sf, "documents").select("doc_id", C.count_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT evidence_id, seq, row_number() OVER (PARTITION BY evidence_id ORDER BY start_offset) - 1 AS again FROM ch")
def chunk_renumbering(spark, sf):
    """The number of a chunk follows from its offset."""
    chunks = D.ch(spark, sf).select("evidence_id", F.col("seq").alias("before"), "start_offset", "end_offset")
    again = C.renumber(chunks.withColumn("seq", F.lit(0)))
    return again.select("evidence_id", F.col("before").cast("long").alias("seq"), F.col("seq").cast("long").alias("again"))


@query("SELECT evidence_id, corpus_version FROM ev WHERE corpus_version <= 100")
def snapshot(spark, sf):
    """Evidence known at a version."""
    return C.as_of(D.ev(spark, sf), 100).select("evidence_id", "corpus_version")


@query("""
    SELECT c.chunk_id, e.corpus_version, e.doc_id FROM ch c JOIN ev e ON e.evidence_id = c.evidence_id
    WHERE c.seq % 2 = 1""")
def chunks_without_vectors(spark, sf):
    """C11: chunks still to embed, at their evidence's version."""
    evidence = D.ev(spark, sf)
    chunks = D.ch(spark, sf)
    held = chunks.filter(F.col("seq") % 2 == 0).select("chunk_id")
    found = C.missing_embeddings(chunks, evidence, held)
    return found.join(evidence.select("evidence_id", "doc_id"), "evidence_id").select("chunk_id", "corpus_version", "doc_id")


@query("SELECT chunk_id, length(text) AS first, CAST(corpus_version AS BIGINT) AS corpus_version FROM ch WHERE seq % 2 = 1")
def embedded_chunks(spark, sf):
    """A plugged-in model over the missing chunks (here: text length as a vector)."""
    evidence, chunks = D.ev(spark, sf), D.ch(spark, sf)
    held = chunks.filter(F.col("seq") % 2 == 0).select("chunk_id")
    found = C.embed_chunks(C.missing_embeddings(chunks, evidence, held), lambda texts: [[float(len(t)), 1.0] for t in texts])
    return found.select("chunk_id", F.get("embedding", F.lit(0)).cast("long").alias("first"), "corpus_version")


@query("""
    SELECT min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, count(*) AS vectors, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS consistent FROM embeddings""")
def vector_dimensions(spark, sf):
    """One dimension for all vectors."""
    return C.vector_dims(D.vecs(spark, sf), 64)


@query("""
    SELECT e.workspace, max(e.corpus_version) AS corpus_version, count(*) AS documents, max(c.n) AS chunks
    FROM ev e JOIN (SELECT workspace, count(*) AS n FROM ch GROUP BY 1) c ON c.workspace = e.workspace GROUP BY 1""")
def corpus_catalogue(spark, sf):
    """C14: size and version of every workspace."""
    return C.catalogue(D.ev(spark, sf), D.ch(spark, sf))
