"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from vouchspark.llm import chat, decontaminate, hard_negatives, jaccard_join, langid, middle, mixing, packing, quality, token_files, toxicity, url_tree, vector_dedup
from vouchspark.llm.registry import QUERIES, SQL, query, table  # noqa: F401
from vouchspark.llm.samples import held_out

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
CAPACITY = 4096


@query()
def op3_token_files(spark, folder):
    docs = table(spark, folder, "documents")
    return token_files.token_files(docs, public_tokenizers.path(BYTE_BPE))


@query()
def op5_packed_sequences(spark, folder):
    docs = table(spark, folder, "documents")
    return packing.packed_documents(docs, public_tokenizers.path(WORD_BPE), end_id=1, capacity=CAPACITY)


@query()
def op2_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    judged = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query()
def op8_source_mix(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op1_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.CUT).cast("int").alias("predicted")
    )


@query(
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reached) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.reached FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
)
def op7_jaccard_join(spark, folder):
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


@query(
    """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, reached) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.reached FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.links, 0)::BIGINT AS n_links, coalesce(c.component, e.vec_id) AS component_id,
  coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
)
def op10_vector_dedup(spark, folder):
    return vector_dedup.vector_components(table(spark, folder, "embeddings"))


@query(
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o END AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) s(k) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.doc_id, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) > n_words
    OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 2 * len(regexp_extract_all(t, '\p{L}')) < word_chars) AS kept
FROM b
"""
)
def op6_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LEVEL = """
l{k} AS (SELECT s.*, CASE WHEN s.m < {k} THEN p{j} ELSE p{j} || '/' || CASE WHEN v.any THEN '*' ELSE s.s[{k}] END END AS p{k}
  FROM {before} s LEFT JOIN (SELECT p{j}, true AS any FROM {before} WHERE m >= {k} GROUP BY p{j}
    HAVING count(DISTINCT s[{k}]) >= 8 AND sum(n) < 4 * count(DISTINCT s[{k}])) v USING (p{j})),"""


@query(
    r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM q),
r AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
  regexp_replace(path, '[0-9]+', '0', 'g') AS shape FROM fit),
l0 AS (SELECT host AS p0, host, shape, string_split(shape, '/')[2:] AS s, CASE WHEN shape = '' THEN 0 ELSE len(string_split(shape, '/')) - 1 END AS m,
  count(*) AS n, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM r GROUP BY ALL),"""
    + "".join(_LEVEL.format(k=k, j=k - 1, before=f"l{k - 1}") for k in (1, 2, 3))
    + """
t AS (SELECT host, shape, a, b, CASE WHEN m > 3 THEN p3 || '/**' ELSE p3 END AS template,
  CASE m WHEN 0 THEN host WHEN 1 THEN p0 WHEN 2 THEN p1 WHEN 3 THEN p2 ELSE p3 END AS parent FROM l3),
g AS (SELECT host, parent, template, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM t GROUP BY ALL),
w AS (SELECT *, sum(a) OVER p AS ta, sum(b) OVER p AS tb FROM g WINDOW p AS (PARTITION BY parent)),
x AS (SELECT *, CASE WHEN (a + b) * (ta + tb - a - b) * ta * tb > 0
  THEN (ta + tb) * (a * (tb - b) - b * (ta - a)) * (a * (tb - b) - b * (ta - a)) / ((a + b) * (ta + tb - a - b) * ta * tb) >= 3.841 ELSE false END AS alone FROM w),
y AS (SELECT *, sum(a) FILTER (NOT alone) OVER p AS ma, sum(b) FILTER (NOT alone) OVER p AS mb FROM x WINDOW p AS (PARTITION BY parent)),
z AS (SELECT host, parent, template, CASE WHEN (CASE WHEN alone THEN a ELSE ma END + 3) / (CASE WHEN alone THEN a + b ELSE ma + mb END + 4) < 0.5
  THEN 'block' ELSE 'allow' END AS judged FROM y)
SELECT page_id, r.host, r.path, r.rule, coalesce(r.ruled, z.judged) AS verdict
FROM r JOIN t ON r.host = t.host AND r.shape = t.shape JOIN z ON z.host = t.host AND z.parent = t.parent AND z.template = t.template
"""
)
def op9_url_filters(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_tree.url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


@query()
def op4_chat_repair(spark, folder):
    return chat.repaired_turns(table(spark, folder, "conversations"))


@query(
    """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents),
x AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, CASE WHEN n = 0 OR doc_id IS NULL OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM x),
p AS (SELECT doc_id, t, n, form, a, b, left(t, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
)
def op13_fill_in_middle(spark, folder):
    docs = table(spark, folder, "documents")
    return middle.transform(docs, texts=False, digests=True).drop("pieces", "output")


@query(
    """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""
)
def op12_hard_negatives(spark, folder):
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", moved.alias("label"), "embedding"))


_BENCH_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_BENCH_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
o AS (SELECT p.r, p.i, p.n, g.item_id FROM p JOIN g ON g.n = p.n AND g.g = p.g),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
)
def op11_decontaminate(spark, folder):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    marked = decontaminate.measure(docs.select("doc_id", "text"), items)
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
