"""The derived tables once more, as SQL text for the side-by-side check.

``with_tables("hits", "SELECT ...")`` prefixes a statement with the common table
expressions it names, in dependency order.
"""

from __future__ import annotations

import re

from vouchspark.plans.stem_sql import stems

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def iso(expr: str) -> str:
    return f"(strftime({expr}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"


TABLES: dict[str, str] = {
    "first_docs": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "ev": """
        SELECT upper(substr(f.sha256, 1, 26)) AS evidence_id, f.sha256, d.doc_id, d.text, d.lang, d.source,
               'text/plain' AS mime_type,
               'docs/' || d.source || '/' || d.doc_id || '.txt' AS source_path,
               CAST(d.doc_id AS VARCHAR) AS title,
               'ws' || (d.doc_id % 4) AS workspace,
               row_number() OVER (ORDER BY d.doc_id) AS corpus_version
        FROM documents d JOIN first_docs f ON d.doc_id = f.doc_id""",
    "pieces": r"""
        SELECT *, len(w) AS n,
               CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1
                    ELSE CAST(ceil((len(w) - 200) / 175.0) AS BIGINT) + 1 END AS windows
        FROM (SELECT *, regexp_extract_all(text, '(?:[\p{Han}\p{Hiragana}\p{Katakana}]|[^ \t\r\n\f\p{Han}\p{Hiragana}\p{Katakana}]{1,64})[ \t\r\n\f]*') AS w,
                     length(text) - length(regexp_replace(text, '^[ \t\r\n\f]+', '')) AS lead FROM ev)""",
    "ch": r"""
        SELECT upper(substr(sha256(sha256 || ':' || seq), 1, 26)) AS chunk_id, evidence_id, sha256, corpus_version,
               workspace, seq, title, source_path,
               regexp_replace(array_to_string(list_slice(w, seq * 175 + 1, least(seq * 175 + 200, n)), ''), '[ \t\r\n\f]+$', '') AS text,
               least(200, n - seq * 175) AS token_count,
               lead + length(array_to_string(list_slice(w, 1, seq * 175), '')) AS start_offset
        FROM (SELECT *, unnest(range(windows)) AS seq FROM pieces)""",
    "cl": """
        SELECT item_id AS claim_id, text AS claim,
               (['general','legal','clinical','biomedical','financial','numeric'])[CAST(item_id % 6 AS INTEGER) + 1] AS domain
        FROM benchmark""",
    "chunk_terms": r"""
        SELECT chunk_id, corpus_version, t, len(t) AS dl
        FROM (SELECT chunk_id, corpus_version, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM ch)""",
    "postings": """
        SELECT chunk_id, corpus_version, dl, term, count(*) AS tf
        FROM (SELECT chunk_id, corpus_version, dl, unnest(t) AS term FROM chunk_terms) GROUP BY ALL""",
    "totals": "SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM chunk_terms",
    "df": "SELECT term, count(*) AS df FROM postings GROUP BY term",
    "qterms": r"""
        SELECT query_id, term, count(*) AS qtf FROM (
          SELECT query_id, unnest(regexp_extract_all(strip_accents(lower(array_to_string(words, ' '))), '[\p{L}\p{N}]+')) AS term
          FROM (SELECT item_id AS query_id,
                       [x FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') IF length(x) > 1 OR strlen(x) > 1] AS words
                FROM benchmark)) GROUP BY ALL""",
    "scored": """
        SELECT q.query_id, p.chunk_id, p.corpus_version,
               q.qtf * (CASE WHEN ln((s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) > 0
                             THEN ln((s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)
               * (p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl))) AS gain
        FROM qterms q JOIN postings p ON p.term = q.term JOIN df d ON d.term = q.term, totals s""",
    "stems": stems("SELECT unnest(t) AS word FROM chunk_terms UNION ALL SELECT term AS word FROM qterms"),
    "stem_postings": """
        SELECT p.chunk_id, p.dl, s.term, CAST(sum(p.tf) AS BIGINT) AS tf FROM postings p JOIN stems s ON s.word = p.term GROUP BY ALL""",
    "stem_df": "SELECT term, count(*) AS df FROM stem_postings GROUP BY term",
    "stem_qterms": "SELECT q.query_id, s.term, sum(q.qtf) AS qtf FROM qterms q JOIN stems s ON s.word = q.term GROUP BY ALL",
    "bm25": "SELECT query_id, chunk_id, round(-sum(gain), 6) AS score FROM scored GROUP BY ALL",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) - 1 AS rank FROM bm25",
    "hits": "SELECT query_id AS claim_id, chunk_id, rank, score FROM ranked WHERE rank < 10",
    "cands": "SELECT claim_id, list(chunk_id ORDER BY rank) AS candidates FROM hits GROUP BY claim_id",
    "vd": """
        SELECT claim_id, candidates,
               (['supported','contradicted','partial','not_found'])[CAST(claim_id % 4 AS INTEGER) + 1] AS label,
               (claim_id * 37 % 101) / 100.0::DOUBLE AS confidence,
               list_concat(CASE WHEN claim_id % 8 = 4 THEN [] ELSE list_slice(candidates, 1, 2) END,
                           CASE WHEN claim_id % 2 = 0 THEN [fake1] ELSE [] END) AS sup,
               list_concat(CASE WHEN claim_id % 8 = 1 THEN list_slice(candidates, 3, 3) ELSE [] END,
                           CASE WHEN claim_id % 8 = 5 THEN [fake2] ELSE [] END) AS con,
               fake1, fake2,
               'Chunk ' || candidates[1] || ' backs this, unlike ' || fake1 || '.' AS reasoning,
               CASE WHEN claim_id % 2 = 1 THEN 'Nothing beyond ' || fake2 || '.' END AS missing_information
        FROM (SELECT *, upper(substr(sha256('fake' || claim_id), 1, 26)) AS fake1,
                     upper(substr(sha256('other' || claim_id), 1, 26)) AS fake2 FROM cands)""",
    "guarded": """
        SELECT *, CASE WHEN (label = 'supported' AND len(s) = 0) OR (label = 'contradicted' AND len(c) = 0)
                         OR (label = 'partial' AND len(s) + len(c) = 0) THEN 'not_found' ELSE label END AS final_label
        FROM (SELECT *, [x FOR x IN sup IF list_contains(candidates, x)] AS s,
                     [x FOR x IN con IF list_contains(candidates, x)] AS c FROM vd)""",
    "pred": """
        SELECT d.doc_id, e.source AS source_ds,
               CASE WHEN quality = 1 THEN 'supported' ELSE 'not_found' END AS expected,
               CASE WHEN d.doc_id % 31 = 0 THEN NULL
                    WHEN (quality = 1) = (d.doc_id % 7 <> 0) THEN 'supported' ELSE 'not_found' END AS predicted,
               (d.doc_id * 7919 % 1001) / 1000.0::DOUBLE AS confidence
        FROM labels d JOIN ev e ON e.doc_id = d.doc_id""",
    "pred_big": """
        SELECT l_linestatus AS source_ds,
               CASE WHEN l_partkey % 3 = 0 THEN 'supported' ELSE 'not_found' END AS expected,
               CASE WHEN l_returnflag = 'N' THEN 'supported' ELSE 'not_found' END AS predicted,
               round(l_discount * 10, 1) AS confidence
        FROM lineitem""",
    "cm": """
        SELECT source_ds,
               CAST(count(*) FILTER (predicted = 'supported' AND expected = 'supported') AS DOUBLE) AS tp,
               CAST(count(*) FILTER (predicted = 'supported' AND expected <> 'supported') AS DOUBLE) AS fp,
               CAST(count(*) FILTER (predicted <> 'supported' AND expected <> 'supported') AS DOUBLE) AS tn,
               CAST(count(*) FILTER (predicted <> 'supported' AND expected = 'supported') AS DOUBLE) AS fn
        FROM pred_big GROUP BY source_ds""",
    "gold": """
        SELECT claim_id, (['supported','contradicted','not_found'])[CAST(claim_id % 3 AS INTEGER) + 1] AS expected_label,
               CASE WHEN claim_id % 5 <> 0 THEN relevant END AS relevant, claim_id * 10 + 100 AS corpus_version
        FROM (SELECT query_id AS claim_id, list_sort(coalesce(list(chunk_id) FILTER (rank IN (1, 3, 12)), [])) AS relevant
              FROM ranked WHERE rank < 13 GROUP BY query_id)""",
    "atoms": """
        SELECT l_orderkey AS claim_id, CASE WHEN l_returnflag = 'N' THEN 'supported' ELSE 'not_found' END AS label,
               round(l_discount * 10, 1) AS confidence FROM lineitem""",
    "runs": f"""
        SELECT o_orderkey AS run_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'verify_claim' WHEN '2' THEN 'search_evidence'
                    WHEN '3' THEN 'extract_claims' ELSE 'research_topic' END AS skill,
               'ws' || (o_custkey % 8) AS workspace, o_orderkey % 50 + 1 AS corpus_version,
               {iso('o_orderdate')} AS started_at,
               CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'running' ELSE 'error' END AS status
        FROM orders""",
    "calls": """
        SELECT l_orderkey AS run_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               (['small','medium','large'])[CAST(l_suppkey % 3 AS INTEGER) + 1] AS model,
               CAST(l_quantity * 10 AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice / 100) AS BIGINT) AS output_tokens,
               l_partkey % 50 AS cache_read
        FROM lineitem""",
    "rollup_calls": """
        SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
               CAST(sum(cache_read) AS BIGINT) AS total_cache_read, count(*) AS n_calls,
               first(model ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS model
        FROM calls GROUP BY run_id""",
    "steps": """
        SELECT run_id, i AS step_index, CAST(run_id + i + 1 AS VARCHAR) AS child_run_id,
               CASE WHEN (run_id + i) % 4 = 0 THEN 'error' ELSE 'ok' END AS status, run_id % 2 = 0 AS fanout
        FROM (SELECT run_id, unnest(range(run_id % 2 + 2)) AS i FROM runs WHERE run_id % 3 = 0)""",
    "returned": """
        SELECT run_id, i AS rank, 'c' || (run_id + i) AS chunk_id, 'e' || ((run_id + i) % 700) AS evidence_id,
               round(-(run_id % 17 + i) / 10.0::DOUBLE, 6) AS score
        FROM (SELECT run_id, unnest(range(run_id % 4 + 1)) AS i FROM runs)""",
    "vecs": "SELECT CAST(vec_id AS VARCHAR) AS chunk_id, vec_id, vec_id % 10 + 1 AS corpus_version, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "near": """
        SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS rank
        FROM (SELECT q.vec_id AS query_id, v.chunk_id, round(list_distance(q.embedding, v.embedding), 6) AS distance
              FROM vecs q, vecs v WHERE v.corpus_version <= 7)""",
    "proposals": f"""
        SELECT event_id AS approval_id, row_number() OVER (ORDER BY event_id) AS idx, 'ws' || (event_id % 4) AS workspace,
               event_id % 2 + 1 AS approvers_required, event_id * 3 AS source_run_id, {iso('ts')} AS created_at,
               (['fs.write_file','mail.send','shell.run'])[CAST(event_id % 3 AS INTEGER) + 1] AS executor,
               event_id % 29 <> 0 AS has_action
        FROM events WHERE event_type = 'purchase'""",
    "keyed": "SELECT *, CASE WHEN idx % 7 <> 0 THEN 'key' || (idx % 1500) ELSE CAST(approval_id AS VARCHAR) END AS key FROM proposals",
    "decisions": f"""
        SELECT d.*, coalesce(p.approval_id, -d.idx) AS approval_id, p.approvers_required
        FROM (SELECT event_id AS decision_id, event_id % ((SELECT count(*) FROM proposals) + 5) + 1 AS idx,
                     CASE WHEN event_type = 'error' THEN 'reject' WHEN event_id % 101 = 0 THEN 'maybe' ELSE 'accept' END AS decision,
                     CASE WHEN event_id % 97 <> 0 THEN 'u' || user_id END AS decided_by,
                     {iso('ts')} AS decided_at, 'note ' || event_id AS note
              FROM events WHERE event_type IN ('click', 'view', 'error')) d
        LEFT JOIN proposals p ON p.idx = d.idx""",
    "first_votes": """
        SELECT * FROM decisions WHERE decision <> 'maybe' AND decided_by IS NOT NULL AND approvers_required IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY approval_id, decided_by ORDER BY decided_at, decision_id) = 1""",
    "tallied": """
        SELECT *, sum(CASE WHEN decision = 'accept' THEN 1 ELSE 0 END) OVER w AS accepts,
                  sum(CASE WHEN decision = 'reject' THEN 1 ELSE 0 END) OVER w AS rejects
        FROM first_votes WINDOW w AS (PARTITION BY approval_id ORDER BY decided_at, decision_id)""",
    "terminal": """
        SELECT *, CASE WHEN rejects > 0 THEN 'rejected' ELSE 'approved' END AS new_status
        FROM tallied WHERE rejects > 0 OR accepts >= approvers_required
        QUALIFY row_number() OVER (PARTITION BY approval_id ORDER BY decided_at, decision_id) = 1""",
    "folded": """
        SELECT p.*, coalesce(t.new_status, 'pending') AS status, t.decided_at, t.decided_by, t.note AS decision_note, t.decision_id AS last_id
        FROM proposals p LEFT JOIN terminal t ON t.approval_id = p.approval_id""",
    "attempts": f"""
        SELECT p.approval_id, e.event_id AS attempt_id, e.value > 20 AS ok, {iso('e.ts')} AS tried, e.ts AS at_time
        FROM events e JOIN proposals p ON p.idx = e.event_id % 400 + 1 WHERE e.event_type = 'signup'""",
    "files": """
        SELECT source_path AS path, CASE WHEN doc_id % 60 = 1 THEN sha256(text || '!') ELSE sha256 END AS sha256
        FROM ev WHERE doc_id % 50 <> 0""",
    "bad_urls": r"""
        SELECT page_id, html AS body,
               CASE page_id % 20 WHEN 3 THEN regexp_replace(url, '^https?', 'ftp')
                    WHEN 5 THEN regexp_replace(url, '^(https?://)', '\1user:pw@')
                    WHEN 7 THEN 'http://10.0.0.1/private' WHEN 9 THEN 'http://169.254.169.254/latest'
                    WHEN 11 THEN 'https:///nohost' WHEN 13 THEN 'http://[::1]/loop' WHEN 15 THEN 'http://100.64.3.2/shared'
                    ELSE url END AS url,
               CASE page_id % 20 WHEN 17 THEN 'image/png' WHEN 18 THEN 'application/pdf' ELSE 'text/html' END AS mime_type
        FROM pages""",
}


def needed(sql: str) -> list[str]:
    """Names of the tables a statement uses, directly or through others, in order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(TABLES[name])
                order.append(name)

    visit(sql)
    return order


def with_tables(sql: str) -> str:
    names = needed(sql)
    if not names:
        return sql
    prefix = ",\n".join(f"{name} AS ({TABLES[name]})" for name in names)
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {prefix},\n{sql.lstrip()[5:]}"
    return f"WITH {prefix}\n{sql}"
