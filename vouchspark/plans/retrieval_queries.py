"""Queries over retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchspark.functions.text import query_tokens, stem_word, terms
from vouchspark.operators import retrieval as R
from vouchspark.operators.scaling import global_positions
from vouchspark.plans import derived as D
from vouchspark.plans.registry import query
from vouchspark.plans.stem_sql import stems


@query(r"""
    SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1""")
def index_terms(spark, sf):
    """Analysed words of all documents, stemming off."""
    return D.documents(spark, sf).select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_DOCUMENT_WORDS = r"SELECT unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS word FROM documents"


@query(f"SELECT s.term, count(*) AS n FROM ({_DOCUMENT_WORDS}) w JOIN ({stems(_DOCUMENT_WORDS)}) s ON s.word = w.word GROUP BY 1")
def stemmed_terms(spark, sf):
    """The same with stemming, once per distinct word."""
    words = D.documents(spark, sf).select(F.explode(terms(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select(stem_word("word").alias("term"), "n").groupBy("term").agg(F.sum("n").alias("n"))


STEMMED_SQL = """
    WITH g AS (SELECT q.query_id, p.chunk_id, q.qtf * (CASE WHEN ln((t.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) > 0
                 THEN ln((t.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)
               * (p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / t.avgdl))) AS gain
        FROM stem_qterms q JOIN stem_postings p ON p.term = q.term JOIN stem_df d ON d.term = q.term, totals t),
    b AS (SELECT query_id, chunk_id, round(-sum(gain), 6) AS score FROM g GROUP BY ALL)
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) - 1 AS rank FROM b
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) <= 10"""


@query(STEMMED_SQL)
def stemmed_hits(spark, sf):
    """Best ten chunks of every claim, words compared by their stems."""
    return R.bm25_topk(D.questions(spark, sf), R.build_index(D.stored_ch(spark, sf), stem=True), 10)


@query(r"""
    SELECT item_id AS query_id, array_to_string([x FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') IF length(x) > 1 OR strlen(x) > 1], ' ') AS words FROM benchmark""")
def cleaned_queries(spark, sf):
    """R2: query words, one-letter noise removed."""
    return D.questions(spark, sf).select("query_id", F.array_join(query_tokens(F.col("query")), " ").alias("words"))


@query("SELECT chunk_id, term, tf, dl FROM postings")
def inverted_index(spark, sf):
    """Postings with term frequency and chunk length."""
    return R.build_index(D.ch(spark, sf)).postings.select("chunk_id", "term", "tf", F.col("dl").cast("long"))


@query("SELECT count(*) AS n_chunks, CAST(sum(dl) AS BIGINT) AS total_len FROM chunk_terms")
def index_totals(spark, sf):
    """Corpus totals of the index."""
    return R.index_totals(R.build_index(D.ch(spark, sf)))


@query("SELECT claim_id, chunk_id, rank, score FROM hits")
def bm25_hits(spark, sf):
    """Best ten chunks of every claim."""
    return D.hits(spark, sf)


@query("""
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) - 1 AS rank
    FROM (SELECT query_id, chunk_id, round(-sum(gain), 6) AS score FROM scored WHERE corpus_version <= 150 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) <= 50""")
def bm25_snapshot(spark, sf):
    """Top 50 inside a snapshot, frequencies from the whole index."""
    return R.bm25_topk(D.questions(spark, sf), R.build_index(D.stored_ch(spark, sf, versioned=True)), 50, corpus_version=150)


@query("""
    WITH p AS (SELECT * FROM postings WHERE corpus_version <= 150),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM chunk_terms WHERE corpus_version <= 150),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    w AS (SELECT q.query_id, q.term, q.qtf * (CASE WHEN ln((s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) > 0 THEN ln((s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END) AS w
          FROM qterms q JOIN f ON f.term = q.term, s),
    g AS (SELECT w.query_id, p.chunk_id, round(-sum(w.w * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl))), 6) AS score
          FROM w JOIN p ON p.term = w.term, s GROUP BY ALL)
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) - 1 AS rank FROM g
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) <= 50""")
def bm25_snapshot_stats(spark, sf):
    """The same with frequencies of the snapshot, stable as the corpus grows."""
    index = R.build_index(D.stored_ch(spark, sf, versioned=True))
    return R.bm25_topk(D.questions(spark, sf), index, 50, corpus_version=150, stats_scope="snapshot")


@query("""
    SELECT chunk_id, evidence_id, seq, row_number() OVER (ORDER BY evidence_id, seq) - 1 AS rank, 0.0::DOUBLE AS score
    FROM ch WHERE corpus_version <= 120 ORDER BY evidence_id, seq LIMIT 50""")
def all_chunks(spark, sf):
    """Chunks without matching, up to the limit."""
    return R.select_all(D.ch(spark, sf, versioned=True), corpus_version=120).withColumn("seq", F.col("seq").cast("long"))


@query("""
    SELECT e.doc_id AS query_id, chunk_id, c.evidence_id, seq AS rank, 0.0::DOUBLE AS score, count(*) OVER (PARTITION BY e.doc_id) AS chunks_found, false AS truncated
    FROM ch c JOIN ev e ON e.evidence_id = c.evidence_id""")
def all_chunks_each(spark, sf):
    """The passage of every document, one request per document."""
    requests = D.unversioned(spark, sf).select(F.col("doc_id").alias("query_id"), "evidence_id", F.lit(None).cast("long").alias("as_of"))
    return R.select_all_each(requests, D.ch(spark, sf))


@query("""
    SELECT query_id, chunk_id, rank, chunks_found, chunks_found > 3 AS truncated FROM (
      SELECT e.doc_id AS query_id, chunk_id, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY e.doc_id) AS chunks_found
      FROM ch c JOIN ev e ON e.evidence_id = c.evidence_id WHERE c.corpus_version <= 120 WINDOW w AS (PARTITION BY e.doc_id ORDER BY seq)) WHERE rank < 3""")
def first_chunks_each(spark, sf):
    """A caller's limit inside a snapshot, with the full count and a mark."""
    requests = D.unversioned(spark, sf).select(F.col("doc_id").alias("query_id"), "evidence_id", F.lit(120).cast("long").alias("as_of"))
    return R.select_all_each(requests, D.ch(spark, sf, versioned=True), 3).select("query_id", "chunk_id", "rank", "chunks_found", "truncated")


@query("SELECT query_id, chunk_id, distance, rank FROM near WHERE rank < 10")
def nearest_vectors(spark, sf):
    """Ten nearest vectors of every vector, inside a snapshot."""
    return R.knn_topk(D.query_vecs(spark, sf), D.vecs(spark, sf), 10, corpus_version=7)


@query("SELECT query_id, chunk_id, distance, rank FROM near WHERE rank < 5")
def nearest_vectors_blocked(spark, sf):
    """The block-by-block way for query sets that are too large to broadcast."""
    return R.knn_topk(D.query_vecs(spark, sf), D.vecs(spark, sf), 5, corpus_version=7, broadcast_bytes=100_000, block_rows=200)


@query("""
    SELECT h.claim_id AS query_id, h.chunk_id, h.score, c.evidence_id, c.title AS evidence_title, length(c.text) AS n_chars,
           row_number() OVER (PARTITION BY claim_id ORDER BY h.rank) - 1 AS rank
    FROM hits h JOIN ch c ON c.chunk_id = h.chunk_id WHERE c.seq > 0""")
def hydrated_hits(spark, sf):
    """Hits with text and title; hits whose chunk is gone drop out and ranks close up."""
    chunks = D.stored_ch(spark, sf)
    hits = D.hits(spark, sf, chunks).withColumnRenamed("claim_id", "query_id")
    found = R.hydrate(hits, chunks.filter(F.col("seq") > 0), D.unversioned(spark, sf))
    return found.select("query_id", "chunk_id", "score", "evidence_id", "evidence_title", F.length("text").cast("long").alias("n_chars"), "rank")


FUSION_SQL = """
    WITH lex AS (SELECT query_id, chunk_id, rank, -CAST(rank AS DOUBLE) AS score FROM near WHERE rank < 30 AND rank % 3 <> 1),
    lexr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) - 1 AS rank FROM lex),
    vec AS (SELECT query_id, chunk_id, rank FROM near WHERE rank < 20),
    fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS fused_score, coalesce(max(score), 0.0::DOUBLE) AS score
              FROM (SELECT query_id, chunk_id, rank, score FROM lexr UNION ALL SELECT query_id, chunk_id, rank, NULL FROM vec) GROUP BY ALL)
    SELECT query_id, chunk_id, round(fused_score, 9) AS fused_score, score,
           row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) - 1 AS rank FROM fused
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) <= 15"""


@query(FUSION_SQL)
def fused_ranks(spark, sf):
    """Reciprocal rank fusion of two lists per query."""
    near = R.knn_topk(D.query_vecs(spark, sf), D.vecs(spark, sf), 30, corpus_version=7)
    lexical = near.filter(F.col("rank") % 3 != 1).withColumn("score", -F.col("rank").cast("double"))
    lexical = R.ranked(lexical.drop("rank"), 30, [F.col("score").asc()])
    fused = R.rrf_fuse(lexical, near.filter(F.col("rank") < 20), limit=15)
    return fused.withColumn("fused_score", F.round("fused_score", 9))


@query("""
    SELECT query_id, chunk_id, rank, score, 'bm25' AS method, true AS fallback, count(*) OVER (PARTITION BY query_id) AS candidates_considered
    FROM ranked WHERE rank < 20""")
def retrieval_fallback(spark, sf):
    """A model without vectors falls back to BM25 and says so."""
    chunks = D.stored_ch(spark, sf)
    corpus = R.Corpus(chunks, D.unversioned(spark, sf), R.build_index(chunks), embedding_model="m")
    return R.retrieve(D.questions(spark, sf), corpus, limit=20)


HYBRID_CHUNKS = """
    c AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS p FROM (SELECT DISTINCT chunk_id FROM hits)),
    v AS (SELECT c.chunk_id, CAST(e.embedding AS DOUBLE[]) AS embedding FROM c JOIN embeddings e ON e.vec_id = c.p % 400),
    n AS (SELECT q.vec_id AS query_id, v.chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(q.embedding AS DOUBLE[]), v.embedding), 6), v.chunk_id) - 1 AS rank
          FROM embeddings q, v WHERE q.vec_id < (SELECT count(*) FROM benchmark))"""


@query(f"""
    WITH {HYBRID_CHUNKS},
    legs AS (SELECT query_id, chunk_id, rank, score FROM ranked WHERE rank < 20 UNION ALL SELECT query_id, chunk_id, rank, NULL FROM n WHERE rank < 20),
    f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (61 + rank)), 12) AS fs, coalesce(max(score), 0.0::DOUBLE) AS score FROM legs GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, chunk_id) - 1 AS rank, count(*) OVER (PARTITION BY query_id) AS candidates_considered FROM f)
    SELECT query_id, chunk_id, rank, score, 'hybrid_rrf' AS method, false AS fallback, candidates_considered FROM r WHERE rank < 20""")
def retrieval_hybrid(spark, sf):
    """Both lists fused, with the size of their union as candidates considered."""
    chunks = D.stored_ch(spark, sf)
    seen = D.recorded_hits(spark, sf, chunks).select("chunk_id").distinct()
    places = global_positions(seen, ["chunk_id"], "p", start=-1)
    base = D.load(spark, sf, "embeddings")
    vectors = places.join(base, F.col("vec_id") == F.col("p") % 400).select("chunk_id", F.lit(1).alias("corpus_version"), "embedding")
    asked = D.questions(spark, sf)
    query_vectors = base.join(asked, F.col("vec_id") == F.col("query_id"), "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    corpus = R.Corpus(chunks, D.unversioned(spark, sf), R.build_index(chunks), vectors, "m")
    return R.retrieve(asked, corpus, limit=20, query_vectors=query_vectors)


@query("""
    SELECT h.claim_id AS query_id, h.rank, h.chunk_id, h.score, c.evidence_id, c.title AS evidence_title, c.source_path AS evidence_source_path,
           sha256(c.text) AS text_hash, count(*) OVER (PARTITION BY h.claim_id) AS candidates_considered
    FROM hits h JOIN ch c ON c.chunk_id = h.chunk_id""")
def evidence_search(spark, sf):
    """Search results with everything a reader needs."""
    chunks = D.stored_ch(spark, sf)
    corpus = R.Corpus(chunks, D.unversioned(spark, sf), R.build_index(chunks))
    found = R.search_evidence(D.questions(spark, sf), corpus, 10)
    return found.select(
        "query_id", "rank", "chunk_id", "score", "evidence_id", "evidence_title", "evidence_source_path",
        F.sha2("text", 256).alias("text_hash"), "candidates_considered",
    )
