"""Queries over whole jobs of verification, and the SQL of what they must say."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchspark.functions.ids import REDACTED
from vouchspark.operators import judges as J
from vouchspark.operators import retrieval as R
from vouchspark.operators import verify as V
from vouchspark.operators.verify import MAX_ATOMS, SENTENCE_END
from vouchspark.plans import derived as D
from vouchspark.plans import jobs
from vouchspark.plans.registry import query
from vouchspark.plans.verify_queries import SENTENCES_SQL, _first_chunk_writer, joined

SHARE = "round(len(list_intersect(q.t, list_distinct(k.t))) / CAST(greatest(len(q.t), 1) AS DOUBLE), 6)"
ASKED = "(SELECT query_id, list_distinct(list(term)) AS t FROM qterms GROUP BY 1)"


def _corpus(spark, sf, versioned: bool = False) -> R.Corpus:
    chunks = D.stored_ch(spark, sf, versioned=versioned)
    return R.Corpus(chunks, D.unversioned(spark, sf), R.build_index(chunks))


def strict_judge(claims, hits):
    """The second judge of these queries: the built-in one, half as confident."""
    return J.lexical_judge(claims, hits).withColumn("confidence", F.round(F.col("confidence") / 2, 6))


@query(f"""
    WITH a AS (SELECT claim_id, 'w' || (claim_id % 3) AS workspace, CASE claim_id % 3 WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS cut FROM cl),
    m AS (SELECT h.claim_id, max({SHARE}) AS share FROM hits h JOIN {ASKED} q ON q.query_id = h.claim_id JOIN chunk_terms k ON k.chunk_id = h.chunk_id GROUP BY 1)
    SELECT a.claim_id, a.cut AS threshold, CASE WHEN share >= cut THEN 1 ELSE 2 END AS tier, NOT share >= cut AS escalated,
           CASE WHEN share >= cut THEN share ELSE round(share / 2, 6) END AS confidence,
           CASE WHEN share >= 0.5 THEN 'supported' WHEN share >= 0.25 AND NOT share >= cut THEN 'partial' ELSE 'not_found' END AS label
    FROM a JOIN m ON m.claim_id = a.claim_id""")
def tiered_claims(spark, sf):
    """Two judges, each workspace with its calibrated threshold or the default."""
    asked = D.cl(spark, sf).select("claim_id", "claim", F.lit("tiered").alias("mode"), F.concat(F.lit("w"), (F.col("claim_id") % 3).cast("string")).alias("workspace"))
    policy = spark.sql("SELECT * FROM VALUES ('w0', 0.3D), ('w1', 0.6D) AS p(workspace, escalation_threshold)")
    verdicts, _ = jobs.verify_claims(asked, _corpus(spark, sf), second_judge=strict_judge, policy=policy)
    return verdicts.select("claim_id", "threshold", "tier", "escalated", "confidence", "label")


@query(f"""
    WITH s AS ({SENTENCES_SQL.format(id="item_id", table="benchmark")}),
    n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT item_id, least(i, 3) AS i, string_agg(sentence, ' ' ORDER BY i) AS atom FROM s GROUP BY item_id, least(i, 3)),
    q AS (SELECT item_id, i, atom, list_distinct(regexp_extract_all(strip_accents(lower(array_to_string([x FOR x IN regexp_extract_all(lower(atom), '[\\p{{L}}\\p{{N}}_]+') IF length(x) > 1 OR strlen(x) > 1], ' '))), '[\\p{{L}}\\p{{N}}]+')) AS t FROM c),
    m AS (SELECT q.item_id, q.i, any_value(q.atom) AS atom, max({SHARE}) AS share FROM q JOIN hits h ON h.claim_id = q.item_id JOIN chunk_terms k ON k.chunk_id = h.chunk_id GROUP BY 1, 2)
    SELECT item_id AS claim_id, i AS atom_index, sha256(atom || CASE WHEN i = 0 THEN ' {REDACTED}' ELSE '' END) AS atom_hash, CASE WHEN share >= 0.5 THEN 'supported' ELSE 'not_found' END AS label, share AS confidence FROM m""")
def answered_atoms(spark, sf):
    """The atoms of decomposed claims in the answer; each claim's first atom names an id
    that was not retrieved."""
    cut = lambda text: [a + (f" {FAKE_ID}" if i == 0 else "") for i, a in enumerate(_four(text))]
    asked = D.cl(spark, sf).select("claim_id", "claim", F.lit("decomposed").alias("mode"))
    verdicts, _ = jobs.verify_claims(asked, _corpus(spark, sf), _without_ids, decompose_fn=cut)
    listed = verdicts.select("claim_id", F.posexplode("atom_verdicts").alias("atom_index", "a"))
    return listed.select("claim_id", F.col("atom_index").cast("long"), F.sha2("a.atom", 256).alias("atom_hash"), "a.label", "a.confidence")


FAKE_ID = "0123456789ABCDEF0123456789"


def _without_ids(claims, hits):
    return J.lexical_judge(claims.withColumn("claim", F.replace("claim", F.lit(f" {FAKE_ID}"), F.lit(""))), hits)


def _four(text: str) -> list[str]:
    import re

    # Names of their own: a function that names a module takes all of it to the workers, and a module whose
    # Python functions were used before holds Java objects.
    found = [s.strip(" \t\r\n\f") for s in re.split(SENTENCE_END, text)]
    found = [s for s in found if s] or [text]
    return found if len(found) <= MAX_ATOMS else [*found[: MAX_ATOMS - 1], " ".join(found[MAX_ATOMS - 1 :])]


IDF = "(CASE WHEN ln((t.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) > 0 THEN ln((t.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)"
TF = "(p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / t.avgdl)))"


@query(f"""
    WITH s AS ({SENTENCES_SQL.format(id="item_id", table="benchmark")}),
    u AS (SELECT DISTINCT sentence FROM s),
    w AS (SELECT sentence, unnest(regexp_extract_all(strip_accents(lower(array_to_string([x FOR x IN regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+') IF length(x) > 1 OR strlen(x) > 1], ' '))), '[\\p{{L}}\\p{{N}}]+')) AS term FROM u),
    f AS (SELECT sentence, term, count(*) AS qtf FROM w GROUP BY ALL),
    g AS (SELECT f.sentence, p.chunk_id, round(-sum(f.qtf * {IDF} * {TF}), 6) AS score FROM f JOIN postings p ON p.term = f.term JOIN df d ON d.term = f.term, totals t GROUP BY ALL),
    best AS (SELECT sentence, chunk_id FROM g QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY score, chunk_id) <= 10),
    q AS (SELECT sentence, list_distinct(list(term)) AS t FROM w GROUP BY 1),
    m AS (SELECT q.sentence, max({SHARE}) AS share FROM q JOIN best b ON b.sentence = q.sentence JOIN chunk_terms k ON k.chunk_id = b.chunk_id GROUP BY 1)
    SELECT s.item_id AS doc_id, CASE WHEN share >= 0.5 THEN 'supported' WHEN share >= 0.25 THEN 'partial' ELSE 'not_found' END AS label, count(*) AS claims
    FROM s LEFT JOIN m ON m.sentence = s.sentence GROUP BY ALL""")
def verified_documents(spark, sf):
    """Every claim of a document finds its own evidence; equal claims are judged once."""
    docs = D.load(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return V.label_counts(jobs.verify_documents(docs, _corpus(spark, sf)), ["doc_id"])


@query(f"""
    WITH v AS (SELECT count(*) AS n FROM ev),
    a AS (SELECT claim_id, claim_id % 3 AS m, 3 + claim_id % 5 AS k, v.n * (1 + claim_id % 4) // 4 AS version FROM cl, v),
    b AS (SELECT s.query_id, s.chunk_id, round(-sum(s.gain), 6) AS score FROM scored s JOIN a ON a.claim_id = s.query_id WHERE s.corpus_version <= a.version GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) - 1 AS rank FROM b),
    m AS (SELECT a.claim_id, any_value(a.m) AS m, any_value(a.version) AS version, max({SHARE}) AS share, count(*) AS n
          FROM a JOIN r ON r.query_id = a.claim_id AND r.rank < a.k JOIN {ASKED} q ON q.query_id = a.claim_id JOIN chunk_terms k ON k.chunk_id = r.chunk_id GROUP BY 1)
    SELECT 'run' || claim_id AS replay_of, 'frozen' AS replay_mode, CAST(version AS VARCHAR) AS original_version, version AS corpus_version,
           CASE WHEN claim_id % 2 = 0 THEN 'effective_kwargs' ELSE 'legacy_inputs' END AS kwargs_source, CASE m WHEN 0 THEN 'evidence' WHEN 1 THEN 'binary' ELSE 'tiered' END AS mode,
           CAST(n AS BIGINT) AS chunks, share AS confidence,
           CASE WHEN share >= 0.5 THEN 'supported' WHEN share >= 0.25 AND (m = 0 OR m = 2 AND share < 0.9) THEN 'partial' ELSE 'not_found' END AS label
    FROM m""")
def replayed_runs(spark, sf):
    """Recorded runs of unlike modes, depths and versions run again in one job, as new runs."""
    corpus = _corpus(spark, sf, versioned=True)
    versions, claim = D.ev(spark, sf).count(), F.col("claim_id")
    text = lambda name, value: F.create_map(F.lit(name), value.cast("string"))
    mode = F.when(claim % 3 == 0, "evidence").when(claim % 3 == 1, "binary").otherwise("tiered")
    own = F.map_concat(text("claim", F.col("claim")), text("mode", mode), text("k", 3 + claim % 5), text("_note", claim))
    traces = D.cl(spark, sf).select(
        F.lit(2).alias("schema_version"), F.concat(F.lit("run"), claim.cast("string")).alias("run_id"), F.lit("ws").alias("workspace"),
        F.floor(F.lit(versions) * (1 + claim % 4) / 4).cast("long").alias("corpus_version"), own.alias("inputs"),
        F.when(claim % 2 == 0, F.map_filter(own, lambda name, _: name != "_note")).alias("effective_kwargs"),
        F.struct(F.lit("bm25").alias("method"), F.array().cast("array<struct<chunk_id:string>>").alias("returned")).alias("retrieval"), F.lit("{}").alias("output"),
    )
    runs = jobs.replay(traces, corpus, started_at="2026-01-01T00:00:00.000Z").runs
    told = lambda name: F.try_element_at("inputs", F.lit(name))
    return runs.select(
        told("_replay_of").alias("replay_of"), told("_replay_mode").alias("replay_mode"), told("_original_corpus_version").alias("original_version"), "corpus_version",
        told("_kwargs_source").alias("kwargs_source"), told("mode").alias("mode"), F.size("retrieval.returned").cast("long").alias("chunks"),
        F.get_json_object("output", "$.confidence").cast("double").alias("confidence"), F.get_json_object("output", "$.label").alias("label"),
    )


@query("""
    SELECT 't' || t.claim_id AS topic_id, CASE WHEN m.c IS NULL THEN 'Corpus is silent on this topic.' ELSE CAST(length(t.claim) AS VARCHAR) END AS summary,
           CASE WHEN m.c IS NULL THEN 0 ELSE 1 END AS points, coalesce(m.c, '') AS supporting
    FROM cl t LEFT JOIN (SELECT query_id, min(chunk_id) AS c FROM ranked WHERE rank < 12 AND query_id % 7 <> 0 GROUP BY 1) m ON m.query_id = t.claim_id""")
def researched_topics(spark, sf):
    """Topics with ids of text that retrieve for themselves; blank ones get the fixed answer."""
    topics = D.cl(spark, sf).select(F.concat(F.lit("t"), F.col("claim_id").cast("string")).alias("topic_id"), F.when(F.col("claim_id") % 7 != 0, F.col("claim")).otherwise("").alias("topic"))
    found = jobs.research(topics, _corpus(spark, sf), _first_chunk_writer)
    return found.select("topic_id", "summary", F.size("key_points").alias("points"), joined("supporting_chunk_ids").alias("supporting"))
