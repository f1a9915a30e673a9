"""Queries over verification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from vouchspark.operators import judges as J
from vouchspark.operators import retrieval as R
from vouchspark.operators import verify as V
from vouchspark.operators.scaling import spread
from vouchspark.plans import derived as D
from vouchspark.plans import jobs
from vouchspark.plans.registry import query
from vouchspark.session import reliable_checkpoint


def joined(column):
    return F.array_join(column, ",")


@query("""
    SELECT claim_id, domain, CASE domain WHEN 'general' THEN 'evidence' WHEN 'legal' THEN 'evidence' WHEN 'financial' THEN 'arithmetic' ELSE 'binary' END AS mode FROM cl""")
def routed_claims(spark, sf):
    """V1: domain to mode."""
    return V.route_modes(D.cl(spark, sf)).select("claim_id", "domain", "mode")


@query("""
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'judgment' WHEN d = 'halueval' THEN 'judgment' WHEN d = 'DROP' THEN 'binary' WHEN d IS NULL THEN 'evidence' END AS mode,
           CASE WHEN doc_id % 5 <> 0 AND d = 'weather' THEN 'unknown domain or mode: weather' END AS route_error
    FROM (SELECT doc_id, (['halueval', 'DROP', 'weather', NULL])[CAST(doc_id % 4 AS INTEGER) + 1] AS d FROM documents)""")
def routed_with_quarantine(spark, sf):
    """V1: explicit mode, benchmark aliases, no domain, and unknown domains set aside."""
    domain = F.get(F.array(F.lit("halueval"), F.lit("DROP"), F.lit("weather"), F.lit(None)), (F.col("doc_id") % 4).cast("int"))
    claims = D.load(spark, sf, "documents").select("doc_id", domain.alias("domain"), F.when(F.col("doc_id") % 5 == 0, "judgment").alias("asked"))
    return V.route_modes(claims, strict=False, explicit="asked").select("doc_id", "mode", "route_error")


def hydrated(spark, sf):
    """Hits with their texts, stored once: the judge, the guard and the counts all read them."""
    chunks = D.stored_ch(spark, sf)
    hits = D.hits(spark, sf, chunks).withColumnRenamed("claim_id", "query_id")
    return reliable_checkpoint(R.hydrate(hits, chunks, D.unversioned(spark, sf)).withColumnRenamed("query_id", "claim_id"))


@query(r"""
    SELECT claim_id, sha256('<corpus>' || chr(10) || string_agg('<chunk id="' || h.chunk_id || '" source="' || c.title || '" headings="">' || chr(10) || c.text || chr(10) || '</chunk>', chr(10) ORDER BY h.chunk_id)
           || chr(10) || '</corpus>') AS corpus_hash
    FROM hits h JOIN ch c ON c.chunk_id = h.chunk_id GROUP BY claim_id""")
def corpus_blocks(spark, sf):
    """V2: one byte-stable corpus text per claim."""
    return J.corpus_block(hydrated(spark, sf)).select("claim_id", F.sha2("corpus", 256).alias("corpus_hash"))


LEXICAL = r"""
    shares AS (SELECT h.claim_id, h.chunk_id,
        round(len(list_intersect(q.t, list_distinct(k.t))) / CAST(greatest(len(q.t), 1) AS DOUBLE), 6) AS share
      FROM hits h JOIN (SELECT query_id, list_distinct(list(term)) AS t FROM qterms GROUP BY 1) q ON q.query_id = h.claim_id
      JOIN chunk_terms k ON k.chunk_id = h.chunk_id),
    lexical AS (SELECT claim_id, max(share) AS confidence,
        array_to_string(list_sort(coalesce(list(chunk_id) FILTER (share >= 0.25), [])), ',') AS supporting,
        CASE WHEN max(share) >= 0.5 THEN 'supported' WHEN max(share) >= 0.25 THEN 'partial' ELSE 'not_found' END AS label
      FROM shares GROUP BY claim_id)"""


@query(f"WITH {LEXICAL} SELECT claim_id, label, confidence, supporting FROM lexical")
def lexical_verdicts(spark, sf):
    """V3: every claim scored by the built-in overlap judge."""
    found = J.lexical_judge(D.cl(spark, sf), hydrated(spark, sf))
    return found.select("claim_id", "label", "confidence", joined("supporting_chunk_ids").alias("supporting"))


def _longest_word_judge(frame: pd.DataFrame) -> pd.DataFrame:
    """Plug-in example: a claim counts as faithful if its longest word is in the corpus."""
    longest = frame["claim"].str.split().map(lambda words: max(words, key=len) if words else "")
    faithful = [word in corpus for word, corpus in zip(longest, frame["corpus"])]
    return pd.DataFrame({"claim_id": frame["claim_id"], "faithful": faithful, "confidence": 0.75, "reasoning": longest})


@query("""
    WITH w AS (SELECT claim_id, unnest(string_split_regex(trim(claim), '\\s+')) AS word, generate_subscripts(string_split_regex(trim(claim), '\\s+'), 1) AS i FROM cl),
    l AS (SELECT claim_id, first(word ORDER BY length(word) DESC, i) AS word FROM w GROUP BY 1),
    c AS (SELECT claim_id, string_agg(k.text, chr(10)) AS corpus FROM hits h JOIN ch k ON k.chunk_id = h.chunk_id GROUP BY 1)
    SELECT l.claim_id, CASE WHEN contains(c.corpus, l.word) THEN 'supported' ELSE 'not_found' END AS label, 0.75::DOUBLE AS confidence, l.word AS reasoning
    FROM l JOIN c ON c.claim_id = l.claim_id""")
def plugged_judge(spark, sf):
    """V3, V6: a plugged-in judge over corpus blocks, its yes/no answer mapped to a label."""
    requests = D.cl(spark, sf).join(J.corpus_block(hydrated(spark, sf)), "claim_id").select("claim_id", "claim", "corpus")
    schema = "claim_id long, faithful boolean, confidence double, reasoning string"
    answers = J.judge(requests, _longest_word_judge, schema, parallelism=4)
    return V.map_binary(answers).select("claim_id", "label", "confidence", "reasoning")


ANSWERS_SQL = """
    SELECT claim_id, label, CASE WHEN claim_id % 9 = 0 THEN 1.5 ELSE confidence END AS confidence, reasoning, claim_id % 10 AS d FROM vd"""


@query(f"""
    SELECT claim_id, CASE WHEN d = 1 THEN NULL WHEN d = 2 THEN NULL WHEN d = 3 THEN 'maybe' ELSE label END AS label,
           CASE WHEN d = 1 THEN NULL ELSE confidence END AS confidence,
           CASE WHEN d = 1 THEN 'not a JSON object' WHEN d = 2 THEN 'missing label' WHEN claim_id % 9 = 0 THEN 'confidence outside 0..1'
                WHEN d = 3 THEN 'unknown label' END AS parse_error FROM ({ANSWERS_SQL})""")
def parsed_verdicts(spark, sf):
    """V4: judge answers parsed and checked, with planted faults."""
    vd = D.vd(spark, sf)
    d = F.col("claim_id") % 10
    fields = F.struct(
        F.when(d == 3, "maybe").when(d != 2, F.col("label")).alias("label"),
        F.when(F.col("claim_id") % 9 == 0, 1.5).otherwise(F.col("confidence")).alias("confidence"),
        "reasoning", "supporting_chunk_ids", "contradicting_chunk_ids",
    )
    answers = vd.select("claim_id", F.when(d == 1, F.lit("I think so")).otherwise(F.to_json(fields)).alias("answer"))
    return V.parse_verdicts(answers).select("claim_id", "label", "confidence", "parse_error")


@query("""
    SELECT claim_id, CASE WHEN quality = 1 THEN 'supported' ELSE 'not_found' END AS label,
           CASE WHEN claim_id % 3 = 0 THEN NULL ELSE 0.5::DOUBLE END AS parsed, 'missing confidence' AS e
    FROM (SELECT doc_id AS claim_id, quality FROM labels) WHERE claim_id % 3 = 0
    UNION ALL SELECT claim_id, CASE WHEN quality = 1 THEN 'supported' ELSE 'not_found' END, 0.5::DOUBLE, NULL
    FROM (SELECT doc_id AS claim_id, quality FROM labels) WHERE claim_id % 3 <> 0""")
def parsed_binary_verdicts(spark, sf):
    """V4, V6: yes/no answers parsed and mapped."""
    body = F.to_json(F.struct((F.col("quality") == 1).alias("faithful"), F.when(F.col("doc_id") % 3 != 0, 0.5).alias("confidence"), F.lit("r").alias("reasoning")))
    parsed = V.parse_verdicts(D.load(spark, sf, "labels").select(F.col("doc_id").alias("claim_id"), body.alias("answer")), "binary")
    kept = parsed.withColumn("parsed", F.col("confidence"))
    return V.map_binary(kept).select("claim_id", "label", "parsed", F.col("parse_error").alias("e"))


@query("""
    SELECT doc_id AS claim_id, CASE WHEN quality = 1 THEN 'supported' ELSE 'not_found' END AS label,
           CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, 0 AS citations FROM labels""")
def binary_mapping(spark, sf):
    """V6: unfaithful is not found, a missing confidence is 1.0, citations are emptied."""
    answers = D.load(spark, sf, "labels").select(
        F.col("doc_id").alias("claim_id"), (F.col("quality") == 1).alias("faithful"),
        F.when(F.col("doc_id") % 3 != 0, 0.5).alias("confidence"), F.lit("r").alias("reasoning"),
    )
    mapped = V.map_binary(answers)
    return mapped.select("claim_id", "label", "confidence", F.size(F.concat("supporting_chunk_ids", "contradicting_chunk_ids")).alias("citations"))


@query("""
    SELECT claim_id, 'not_found' AS label, 1.0::DOUBLE AS confidence FROM cl WHERE claim_id NOT IN (SELECT claim_id FROM hits WHERE score <= -19.0::DOUBLE)""")
def silent_claims(spark, sf):
    """V5: claims without (strong) hits are answered without a judge."""
    strong = D.hits(spark, sf).filter(F.col("score") <= -19.0)
    return J.empty_verdicts(D.cl(spark, sf), strong).select("claim_id", "label", "confidence")


def _recorded(spark, sf):
    hits = D.recorded_hits(spark, sf)
    return D.vd(spark, sf, hits).drop("candidates"), hits


@query("""
    SELECT claim_id, array_to_string(s, ',') AS supporting, array_to_string(c, ',') AS contradicting,
           array_to_string(list_sort([x FOR x IN list_concat(sup, con) IF NOT list_contains(candidates, x)]), ',') AS dropped FROM guarded""")
def filtered_citations(spark, sf):
    """V7, V8: citations that were retrieved, and the ids that were not."""
    found = V.filter_citations(V.with_candidates(*_recorded(spark, sf)))
    return found.select(
        "claim_id", joined("supporting_chunk_ids").alias("supporting"), joined("contradicting_chunk_ids").alias("contradicting"),
        joined("dropped_chunk_ids").alias("dropped"),
    )


@query("""
    SELECT claim_id, final_label AS label, final_label <> label AS label_downgraded, confidence FROM guarded""")
def guarded_labels(spark, sf):
    """V9: labels without grounding are downgraded."""
    found = V.guard(V.filter_citations(V.with_candidates(*_recorded(spark, sf))))
    return found.select("claim_id", "label", "label_downgraded", "confidence")


@query("""
    SELECT claim_id, replace(reasoning, fake1, '[unverified-id]') AS reasoning, replace(missing_information, fake2, '[unverified-id]') AS missing_information FROM vd""")
def redacted_prose(spark, sf):
    """Unknown ids in prose are replaced."""
    found = V.redact_verdicts(V.with_candidates(*_recorded(spark, sf)))
    return found.select("claim_id", "reasoning", "missing_information")


@query("""
    SELECT g.claim_id, h.rank, h.chunk_id, 'supporting' AS role FROM guarded g JOIN hits h ON h.claim_id = g.claim_id AND list_contains(g.s, h.chunk_id)
    UNION ALL SELECT g.claim_id, h.rank, h.chunk_id, 'contradicting' FROM guarded g JOIN hits h ON h.claim_id = g.claim_id AND list_contains(g.c, h.chunk_id)""")
def cited_chunk_views(spark, sf):
    """The cited chunks in candidate order."""
    recorded, hits = _recorded(spark, sf)
    found = V.filter_citations(V.with_candidates(recorded, hits))
    both = V.cited_chunks(found, hits, "supporting").unionByName(V.cited_chunks(found, hits, "contradicting"))
    return both.select("claim_id", "rank", "chunk_id", "role")


@query("""
    SELECT claim_id, score, confidence, atoms, CASE WHEN score > 0 THEN 'supported' WHEN score < 0 THEN 'not_found' ELSE 'partial' END AS label FROM (
      SELECT claim_id, round(sum(CASE WHEN label = 'supported' THEN confidence ELSE -confidence END), 6) + 0.0::DOUBLE AS score, round(avg(confidence), 6) AS confidence, count(*) AS atoms
      FROM atoms GROUP BY claim_id)""")
def atom_votes(spark, sf):
    """Confidence-weighted vote over the atoms of every claim."""
    found = V.vote(D.atoms(spark, sf))
    return found.withColumn("score", F.round("score", 6) + 0.0).withColumn("confidence", F.round("confidence", 6))


SENTENCES_SQL = r"""
    SELECT {id} AS {id}, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i, len(s) AS n FROM (
      SELECT {id}, [x FOR x IN [trim(y, chr(32) || chr(9) || chr(13) || chr(10) || chr(12)) FOR y IN string_split(regexp_replace(text, '([.!?])[ \t\r\n\f]+', '\1' || chr(1), 'g'), chr(1))] IF x <> ''] AS s FROM {table})"""


@query(f"""
    WITH s AS ({SENTENCES_SQL.format(id='item_id', table='benchmark')})
    SELECT item_id AS claim_id, least(i, 3) AS atom_index, string_agg(sentence, ' ' ORDER BY i) AS atom FROM s GROUP BY ALL""")
def claim_atoms(spark, sf):
    """Claims split into at most four atoms."""
    return V.decompose(D.cl(spark, sf)).withColumn("atom_index", F.col("atom_index").cast("long"))


@query("""
    SELECT claim_id, CASE WHEN confidence >= 0.5 THEN CASE WHEN label = 'supported' THEN label ELSE 'not_found' END ELSE final_label END AS label,
           CASE WHEN confidence >= 0.5 THEN confidence ELSE round(1 - confidence, 6) END AS confidence,
           CASE WHEN confidence >= 0.5 THEN 1 ELSE 2 END AS tier, confidence < 0.5 AS escalated FROM guarded""")
def tiered_verdicts(spark, sf):
    """Confident first-tier verdicts ship, only the rest is judged again."""
    recorded, hits = _recorded(spark, sf)
    answers = recorded.select("claim_id", (F.col("label") == "supported").alias("faithful"), "confidence", "reasoning")
    first = V.map_binary(answers)
    rest = V.needs_second_tier(first, 0.5).select("claim_id")
    second = V.guarded_verdicts(recorded.join(rest, "claim_id", "left_semi"), hits)
    second = second.withColumn("confidence", F.round(1 - F.col("confidence"), 6))
    return V.tiered(first, second, 0.5)


@query("""
    SELECT run_id, calls, disagreements, round(CAST(disagreements AS DOUBLE) / calls, 6) AS mismatch_rate FROM (
      SELECT l_orderkey AS run_id, count(*) AS calls, count(*) FILTER (l_linenumber IN (3, 5)) AS disagreements FROM lineitem GROUP BY 1)""")
def calculation_rechecks(spark, sf):
    """Recorded sums evaluated again.  Every third line was recorded wrong; the fourth and
    the fifth have two faults, of which the fourth recorded the one that counts."""
    quantity, line = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    expression = F.concat(F.lit("("), quantity.cast("string"), F.lit(" + "), line.cast("string"), F.lit(") * 2 - 1"))
    value = (quantity + line) * 2 - 1 + F.when(line == 3, 1).otherwise(0)
    faulty, recorded = line.isin(4, 5), F.when(line == 4, "ERROR: AST node not allowed: Name").otherwise("ERROR: division by zero")
    asked = F.when(faulty, F.concat(quantity.cast("string"), F.lit(" / 0 + total"))).otherwise(expression)
    found = F.when(faulty, recorded).otherwise(value.cast("string"))
    calls = spread(D.load(spark, sf, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("run_id"), asked.alias("expression"), found.alias("result"))
    return V.calculation_faults(V.recheck_calculations(calls)).withColumn("mismatch_rate", F.round("mismatch_rate", 6))


@query(f"""
    WITH s AS ({SENTENCES_SQL.format(id='doc_id', table='documents')}) SELECT doc_id, i AS claim_index, sha256(sentence) AS claim_hash FROM s""")
def extracted_claims(spark, sf):
    """Claims of every document, one per sentence by default."""
    found = V.extract_claims(D.documents(spark, sf))
    return found.select("doc_id", F.col("claim_index").cast("long"), F.sha2("claim", 256).alias("claim_hash"))


@query("""
    SELECT claim_id AS topic_id, CASE WHEN len(s) > 0 THEN 1 ELSE 0 END + CASE WHEN len(c) > 0 THEN 1 ELSE 0 END AS points,
           array_to_string(list_sort(list_distinct(list_concat(s, c))), ',') AS supporting FROM guarded""")
def key_points(spark, sf):
    """Key points keep only retrieved ids; points without any are dropped."""
    point = lambda name, ids: F.struct(F.lit(name).alias("point"), F.col(ids).alias("supporting_chunk_ids"))
    drafts = D.vd(spark, sf).select(
        F.col("claim_id").alias("topic_id"), "candidates",
        F.array(point("for", "supporting_chunk_ids"), point("against", "contradicting_chunk_ids")).alias("key_points"),
    )
    found = V.filter_key_points(drafts)
    return found.select("topic_id", F.size("key_points").alias("points"), joined("supporting_chunk_ids").alias("supporting"))


def _first_chunk_writer(frame: pd.DataFrame) -> pd.DataFrame:
    """Plug-in example: one point per topic that cites the first chunk of its corpus."""
    first = frame["corpus"].str.extract(r'<chunk id="([^"]+)"')[0]
    points = [[{"point": "first", "supporting_chunk_ids": [x, "missing"]}] for x in first]
    return pd.DataFrame({"topic_id": frame["topic_id"], "summary": frame["topic"].str.len().astype(str), "key_points": points, "gaps": None})


@query("""
    SELECT t.claim_id AS topic_id, CASE WHEN m.c IS NULL THEN 'Corpus is silent on this topic.' ELSE CAST(length(t.claim) AS VARCHAR) END AS summary,
           CASE WHEN m.c IS NULL THEN 0 ELSE 1 END AS points, coalesce(m.c, '') AS supporting
    FROM cl t LEFT JOIN (SELECT query_id, min(chunk_id) AS c FROM ranked WHERE rank < 12 AND query_id % 7 <> 0 GROUP BY 1) m ON m.query_id = t.claim_id""")
def topic_syntheses(spark, sf):
    """One synthesis per topic, and the fixed answer where nothing was found."""
    chunks = D.stored_ch(spark, sf)
    hits = D.hits(spark, sf, chunks, k=V.TOPIC_POOL).filter(F.col("claim_id") % 7 != 0).withColumnRenamed("claim_id", "query_id")
    hydrated_hits = reliable_checkpoint(R.hydrate(hits, chunks, D.unversioned(spark, sf)).withColumnRenamed("query_id", "claim_id"))
    topics = D.cl(spark, sf).select(F.col("claim_id").alias("topic_id"), F.col("claim").alias("topic"))
    found = V.research_topics(topics, hydrated_hits, _first_chunk_writer)
    return found.select("topic_id", "summary", F.size("key_points").alias("points"), joined("supporting_chunk_ids").alias("supporting"))


@query(f"""
    WITH s AS ({SENTENCES_SQL.format(id='item_id', table='benchmark')}),
    q AS (SELECT item_id, i, list_distinct(regexp_extract_all(strip_accents(lower(array_to_string([x FOR x IN regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+') IF length(x) > 1 OR strlen(x) > 1], ' '))), '[\\p{{L}}\\p{{N}}]+')) AS t FROM s),
    m AS (SELECT q.item_id, q.i, max(round(len(list_intersect(q.t, list_distinct(k.t))) / CAST(greatest(len(q.t), 1) AS DOUBLE), 6)) AS share
          FROM q JOIN hits h ON h.claim_id = q.item_id JOIN chunk_terms k ON k.chunk_id = h.chunk_id GROUP BY ALL)
    SELECT item_id AS doc_id, CASE WHEN share >= 0.5 THEN 'supported' WHEN share >= 0.25 THEN 'partial' ELSE 'not_found' END AS label, count(*) AS claims FROM m GROUP BY ALL""")
def document_verdicts(spark, sf):
    """A document's claims extracted, verified against its evidence and counted by label."""
    docs = D.load(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    claims = V.extract_claims(docs).withColumn("claim_id", F.concat_ws("-", "doc_id", "claim_index"))
    evidence = hydrated(spark, sf).select(F.col("claim_id").alias("doc_id"), "chunk_id", "text")
    hits = claims.select("claim_id", "doc_id").join(evidence, "doc_id").select("claim_id", "chunk_id", "text")
    verdicts = J.lexical_judge(claims, hits).join(claims.select("claim_id", "doc_id"), "claim_id")
    return V.label_counts(verdicts, ["doc_id"])


FLAGSHIP_SQL = f"""
    WITH {LEXICAL}
    SELECT label, count(*) AS claims, round(avg(confidence), 6) AS mean_confidence FROM lexical GROUP BY label"""


@query(FLAGSHIP_SQL)
def verified_claims(spark, sf):
    """The whole path: documents, evidence, chunks, hits, verdicts, guard, label counts."""
    claims, found = D.cl(spark, sf), hydrated(spark, sf)
    judged = J.lexical_judge(claims, found).unionByName(J.empty_verdicts(claims, found))
    checked = V.guarded_verdicts(judged, found.select("claim_id", "chunk_id", "rank"))
    return checked.groupBy("label").agg(F.count(F.lit(1)).alias("claims"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))




@query(r"""
    WITH asked AS (SELECT c.*, e.evidence_id, CASE WHEN domain IN ('general', 'legal') THEN 'evidence' WHEN domain = 'financial' THEN 'arithmetic' ELSE 'binary' END AS mode
                   FROM cl c LEFT JOIN ev e ON e.doc_id = c.claim_id),
    cand AS (SELECT a.claim_id, h.chunk_id FROM asked a JOIN hits h ON h.claim_id = a.claim_id WHERE mode = 'evidence' OR a.evidence_id IS NULL
      UNION ALL SELECT a.claim_id, k.chunk_id FROM asked a JOIN ch k ON k.evidence_id = a.evidence_id WHERE mode <> 'evidence'),
    shares AS (SELECT c.claim_id, c.chunk_id, round(len(list_intersect(q.t, list_distinct(k.t))) / CAST(greatest(len(q.t), 1) AS DOUBLE), 6) AS share
      FROM cand c JOIN (SELECT query_id, list_distinct(list(term)) AS t FROM qterms GROUP BY 1) q ON q.query_id = c.claim_id JOIN chunk_terms k ON k.chunk_id = c.chunk_id),
    best AS (SELECT claim_id, max(share) AS confidence, array_to_string(list_sort(coalesce(list(chunk_id) FILTER (share >= 0.25), [])), ',') AS supporting, count(*) AS n FROM shares GROUP BY 1)
    SELECT b.claim_id, a.mode, b.confidence, b.n AS candidates, CASE WHEN mode = 'evidence' THEN supporting ELSE '' END AS supporting,
           CASE WHEN confidence >= 0.5 THEN 'supported' WHEN confidence >= 0.25 AND mode = 'evidence' THEN 'partial' ELSE 'not_found' END AS label
    FROM best b JOIN asked a ON a.claim_id = b.claim_id""")
def verified_by_mode(spark, sf):
    """The verify job: claims routed by domain, matched or given their passage, judged and guarded."""
    chunks, evidence = D.stored_ch(spark, sf), D.unversioned(spark, sf)
    corpus = R.Corpus(chunks, evidence, R.build_index(chunks))
    passages = evidence.select(F.col("doc_id").alias("claim_id"), "evidence_id")
    verdicts, hits = jobs.verify_claims(D.cl(spark, sf).join(passages, "claim_id", "left"), corpus)
    counts = hits.groupBy("claim_id").agg(F.count(F.lit(1)).alias("candidates"))
    return verdicts.join(counts, "claim_id").select("claim_id", "mode", "label", "confidence", "candidates", joined("supporting_chunk_ids").alias("supporting"))
