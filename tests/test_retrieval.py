import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vouchspark.functions.text import porter_stem, query_tokens, terms
from vouchspark.operators import retrieval as R
from vouchspark.plans import derived as D


def ranked_rows(df, *columns):
    return [tuple(r) for r in df.orderBy("query_id", "rank").select(*columns).collect()]


def lists(spark, lex, vec):
    return (
        spark.createDataFrame([(1, c, r, s) for c, r, s in lex], "query_id long, chunk_id string, rank long, score double"),
        spark.createDataFrame([(1, c, r) for c, r in vec], "query_id long, chunk_id string, rank long"),
    )


@pytest.mark.parametrize(
    "lex, vec, want",
    [
        ([("A", 0, -5.0), ("B", 1, -4.0)], [("B", 0), ("C", 1)], [("B", 0, -4.0), ("A", 1, -5.0), ("C", 2, 0.0)]),
        ([], [("V", 0)], [("V", 0, 0.0)]),
        ([("B", 0, -1.0)], [("A", 0)], [("A", 0, 0.0), ("B", 1, -1.0)]),
    ],
)
def test_fusion(spark, lex, vec, want):
    assert ranked_rows(R.rrf_fuse(*lists(spark, lex, vec), limit=10), "chunk_id", "rank", "score") == want


def test_query_words(spark):
    df = spark.createDataFrame([('A "NEAR" b: foo_bar x 日 *',), ("!!",)], "q string")
    assert [r[0] for r in df.select(query_tokens(F.col("q"))).collect()] == [["near", "foo_bar", "日"], []]


def test_analysis_folds_marks(spark):
    df = spark.createDataFrame([("Élan Ünïcode éa naïve-2",)], "t string")
    assert df.select(terms(F.col("t"))).first()[0] == ["elan", "unicode", "ea", "naive", "2"]


@pytest.mark.parametrize(
    "word, stem",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
     ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
     ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"),
     ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"),
     ("controll", "control"), ("roll", "roll"), ("feed", "feed"), ("sized", "size"), ("generalizations", "gener"), ("oscillators", "oscil")],
)
def test_stems(word, stem):
    assert porter_stem(word) == stem


def corpus(spark):
    """One term sits in every chunk and makes up a third of all words."""
    rng = random.Random(5)
    rows = [(f"c{i:03d}", i % 7 + 1, " ".join(["hot"] * rng.randint(1, 20) + rng.choices([f"w{j}" for j in range(60)], k=rng.randint(1, 40)))) for i in range(150)]
    asked = [(q, " ".join(["hot", "hot"] + rng.choices([f"w{j}" for j in range(70)], k=5)) if q else "") for q in range(6)]
    return rows, asked, spark.createDataFrame(rows, "chunk_id string, corpus_version long, text string"), spark.createDataFrame(asked, "query_id long, query string")


def brute_force(rows, asked, k, version=None, scope="index"):
    live = [r for r in rows if version is None or r[1] <= version]
    counted = live if scope == "snapshot" else rows
    docs = {c: text.split() for c, _, text in rows}
    n, avgdl = len(counted), sum(len(docs[c]) for c, *_ in counted) / len(counted)
    out = []
    for q, query in asked:
        words = re.findall(r"\w+", query)
        scores = {}
        for c, *_ in live:
            total = 0.0
            for w in words:
                tf, df = docs[c].count(w), sum(w in docs[x] for x, *_ in counted)
                if tf:
                    idf = math.log((n - df + 0.5) / (df + 0.5))
                    total += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[c]) / avgdl))
            if total:
                scores[c] = round(-total, 6)
        best = sorted((s, c) for c, s in scores.items())[:k]
        out += [(q, c, rank, s) for rank, (s, c) in enumerate(best)]
    return out


@pytest.mark.parametrize("version, scope", [(None, "index"), (3, "index"), (3, "snapshot")])
@pytest.mark.parametrize("limit", [R.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("k", [3, 20])
def test_bm25_equals_brute_force(spark, monkeypatch, version, scope, limit, k):
    """Query words broadcast, or blocks of queries meeting blocks of chunks."""
    monkeypatch.setattr(R, "BLOCK_CHUNKS", 20)
    rows, asked, chunks, queries = corpus(spark)
    found = R.bm25_topk(queries, R.build_index(chunks), k, corpus_version=version, stats_scope=scope, broadcast_bytes=limit)
    got = ranked_rows(found, "query_id", "chunk_id", "rank", "score")
    want = brute_force(rows, asked, k, version, scope)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], abs_tol=2e-6) for g, w in zip(got, want))


@pytest.mark.parametrize("limit", [R.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("scope", ["index", "snapshot"])
def test_stored_and_appended_index_answers_the_same(spark, tmp_path, limit, scope):
    _, _, chunks, queries = corpus(spark)
    first, second = chunks.filter("chunk_id < 'c100'"), chunks.filter("chunk_id >= 'c100'")
    R.write_index(R.build_index(first), str(tmp_path), buckets=4)
    R.write_index(R.build_index(second), str(tmp_path), buckets=4, batch=1)
    stored = R.bm25_topk(queries, R.read_index(spark, str(tmp_path)), 10, corpus_version=4, stats_scope=scope, broadcast_bytes=limit)
    fresh = R.bm25_topk(queries, R.build_index(chunks), 10, corpus_version=4, stats_scope=scope)
    columns = ("query_id", "chunk_id", "rank", "score")
    assert ranked_rows(stored, *columns) == ranked_rows(fresh, *columns)


def test_scoring_shuffles_only_text_and_top_rows(spark):
    """One exchange by chunk (the text) and one by query (the best rows); pairs stay put."""
    _, _, chunks, queries = corpus(spark)
    found = R.bm25_topk(queries, R.build_index(chunks), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("hashpartitioning(chunk_id#" in m and "REPARTITION" in m for m in moves) == 1
    assert not any("query_id" in m and "chunk_id" in m for m in moves) and "WindowGroupLimit" in plan


def test_few_pairs_become_rows(spark):
    """On the given data: what leaves the scoring tasks against all (query, chunk) pairs."""
    from vouchspark.plans import derived as D

    folder = "/root/testdata/sf0.01"
    chunks, queries = D.ch(spark, folder), D.questions(spark, folder)
    rows, scores = [], R.block_scores

    def counted(*args):
        out = scores(*args)
        rows.append(out.count())
        return out

    R.block_scores = counted
    try:
        R.bm25_topk(queries, R.build_index(chunks), 10).count()
    finally:
        R.block_scores = scores
    assert 0 < rows[0] < 0.1 * queries.count() * chunks.count()


def test_blocks_are_skipped_once_they_cannot_win():
    import pandas as pd

    weights = pd.DataFrame({"query_id": ["q"] * 2, "term": ["rare", "often"], "weight": [5.0, 0.1], "until": [None, None]})
    scorer, plain = R._Scorer(weights, 2), R._Scorer(weights, 2)
    strong = pd.DataFrame({"chunk_id": ["a", "b", "c"], "corpus_version": [1, 1, 1], "terms": [["rare"], ["rare", "often"], ["often"]], "gains": [[1.0], [1.0, 1.0], [2.0]]})
    weak = pd.DataFrame({"chunk_id": ["d"] * 50, "corpus_version": [1] * 50, "terms": [["often"]] * 50, "gains": [[2.0]] * 50})
    for s in (scorer, plain):
        s.feed(strong)
    assert scorer.floor[0] == 5.0
    scorer.feed(weak)
    assert scorer.frame().equals(plain.frame()) and scorer.frame()["chunk_id"].tolist() == ["b", "a"]


def test_nearest_vectors(spark):
    vectors = spark.createDataFrame(
        [("b", 1, [0.0, 1.0]), ("a", 1, [0.0, -1.0]), ("c", 2, [0.0, 0.5]), ("d", 1, [3.0, 4.0])], "chunk_id string, corpus_version long, embedding array<float>"
    )
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "query_id long, embedding array<float>")
    for limit in (R.BROADCAST_BYTES, 1):
        found = R.knn_topk(queries, vectors, 2, corpus_version=1, broadcast_bytes=limit, block_rows=2)
        assert ranked_rows(found, "query_id", "chunk_id", "distance") == [(1, "a", 1.0), (1, "b", 1.0), (2, "d", 0.0), (2, "b", 4.242641)]
    assert R.knn_topk(queries.limit(0), vectors, 2).count() == 0


def test_select_all_order_and_limit(spark):
    chunks = spark.createDataFrame([("x", "e2", 0, 1), ("y", "e1", 1, 1), ("z", "e1", 0, 5)], "chunk_id string, evidence_id string, seq int, corpus_version long")
    assert [r.chunk_id for r in R.select_all(chunks, limit=2).orderBy("rank").collect()] == ["z", "y"]
    assert [r.chunk_id for r in R.select_all(chunks, corpus_version=1).orderBy("rank").collect()] == ["y", "x"]
    assert [r.chunk_id for r in R.select_all(chunks, evidence_id="e2").collect()] == ["x"]


def test_nearest_vectors_with_text_ids_and_versions(spark, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 7)
    rng = np.random.default_rng(4)
    vectors = [(f"c{i:02d}", [float(x) for x in rng.integers(0, 4, 3)], int(i % 5)) for i in range(40)]
    queries = [(f"q{i}", [float(x) for x in rng.integers(0, 4, 3)], int(i % 6) if i % 4 else None) for i in range(9)]
    want = []
    for q, v, until in queries:
        near = sorted((round(float(np.linalg.norm(np.array(v) - np.array(w))), 6), c) for c, w, at in vectors if until is None or at <= until)[:4]
        want += [(q, c, d, rank) for rank, (d, c) in enumerate(near)]
    vs = spark.createDataFrame(vectors, "chunk_id string, embedding array<double>, corpus_version long").repartition(3)
    qs = spark.createDataFrame(queries, "query_id string, embedding array<double>, as_of long")
    for budget in (1 << 20, 50):
        got = R.knn_topk(qs, vs, 4, version_per_query=True, broadcast_bytes=budget, block_rows=11)
        assert sorted(tuple(r) for r in got.select("query_id", "chunk_id", "distance", "rank").collect()) == sorted(want)


def test_dispatcher_embeds_queries_at_their_own_version(spark):
    chunks = spark.createDataFrame([("a", "e1", 0, "red fox", None, 2, 1), ("b", "e2", 0, "blue fox", None, 2, 9)], "chunk_id string, evidence_id string, seq int, text string, headings_path string, token_count int, corpus_version long")
    evidence = spark.createDataFrame([("e1", "one", "p"), ("e2", "two", "p")], "evidence_id string, title string, source_path string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 9)], "chunk_id string, embedding array<double>, corpus_version long")
    corpus = R.Corpus(chunks, evidence, R.build_index(chunks), vectors, "letters", lambda texts: [[float("red" in t), float("blue" in t)] for t in texts])
    asked = spark.createDataFrame([("q1", "blue fox", 1), ("q2", "blue fox", 9)], "query_id string, query string, as_of long")
    got = R.retrieve(asked, corpus, limit=5, version_per_query=True).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {("q1", "a"), ("q2", "a"), ("q2", "b")}
    assert {r["method"] for r in got} == {"hybrid_rrf"} and not any(r["fallback"] for r in got)


def test_blocks_grow_before_rows_are_copied_often():
    """Small blocks while these cost few copies of the other side, then larger ones up to the default."""
    assert [R._blocks(n, 200, 100_000) for n in (0, 1000, 600_000, 10_000_000)] == [1, 5, 16, 100]


def test_nearest_keeps_ties_over_many_batches():
    rng = np.random.default_rng(3)
    asked, vectors = rng.integers(0, 3, (40, 4)).astype(float), rng.integers(0, 3, (500, 4)).astype(float)
    ids = np.array([f"c{i:03d}" for i in rng.permutation(500)], dtype=object)
    best = R._Nearest(asked, None, 5)
    for at in range(0, 500, 50):
        best.feed(ids[at : at + 50], vectors[at : at + 50], None)
    distance = np.round(np.sqrt(((asked[:, None] - vectors[None]) ** 2).sum(2)), R.DISTANCE_DIGITS)
    expected = [(q, d, i) for q in range(40) for d, i in sorted(zip(distance[q], ids, strict=True))[:5]]
    assert [tuple(r) for r in best.frame(np.arange(40))[["query_id", "distance", "chunk_id"]].itertuples(index=False)] == expected
    # From the second batch on, only vectors that may come in are looked at.
    assert np.isfinite(best.edge).all()


def test_only_asked_words_are_joined_to_their_stems(spark):
    chunks = spark.createDataFrame([("a", 1, "running runs run"), ("b", 1, "walks walking"), ("c", 1, "other words")], "chunk_id string, corpus_version long, text string")
    index, asked = R.build_index(chunks, stem=True), spark.createDataFrame([("run",), ("walk",)], "term string")
    rows = lambda df: sorted(tuple(r) for r in df.select("chunk_id", "dl", "term", "tf").collect())
    assert rows(index.matching(asked, True)) == rows(index.postings.join(asked, "term", "left_semi")) == [("a", 3, "run", 3), ("b", 2, "walk", 2)]


def test_chunks_are_cut_once(spark):
    """What several steps read is cut from the documents once and stored."""
    plan = D.stored_ch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "stored-" in plan


def _odd_texts(letters, n=200):
    import random

    rng = random.Random(1)
    return [None, "", "  ", " a ", "a" * 64, "a" * 65, "a" * 129 + " b"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(n)]


def test_coded_chunks_hold_what_the_pattern_finds(spark):
    from collections import Counter

    from vouchspark.functions.text import terms

    letters = list("ab Z9\t\n\r\f\x0b\x00.é") + ["ß", " ", "中", "–", "İ", "x" * 70]
    texts = _odd_texts(letters[:11]) + _odd_texts(letters)
    chunks = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], "chunk_id string, corpus_version long, text string").repartition(5)
    words = ["9", "a", "ab", "b", "z", "e", "be", "ß", "zz"]
    got = {r.chunk_id: (r.dl, {words[c]: n for c, n in zip(r.codes, r.tfs, strict=True)}) for r in R.coded(chunks, words).collect()}
    for r in chunks.select("chunk_id", terms(F.col("text")).alias("t")).collect():
        count = Counter(r.t or [])
        assert got[r.chunk_id] == (None if r.t is None else len(r.t), {w: count[w] for w in words if count[w]})


def test_windows_of_plain_texts_are_those_of_the_pattern(spark):
    from vouchspark.operators import corpus as C

    texts = _odd_texts([*"ab Z9\t\n\r\f\x0b\x00.é", "ß", " ", "–", "İ", "x" * 70])
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    one = F.struct(F.lit(0).alias("start"), F.lit(None).cast("string").alias("headings_path"), F.col("text").alias("body"))
    for target, overlap in ((200, 25), (7, 3), (1, 0), (10, 0)):
        for r in docs.filter("text is not null").select(C._word_windows(one, target, overlap).alias("w"), C._plain_windows(target, overlap)("text").alias("p")).collect():
            assert r.w == r.p
    assert C._piece_starts("a 中") is None


def test_folded_words_of_a_batch():
    import pyarrow as pa

    texts = ["x", "cafe\u0301 d\u00e9j\u00e0 9", None, "", "\u0301", "a b\u00fcn\u0303"]
    got = R._plain_words(pa.array(texts)).to_pylist()
    assert [[w for w in words if w] for words in got] == [["x"], ["cafe", "deja", "9"], [], [], [], ["a", "bun"]]


def test_pieces_of_a_batch_of_bytes():
    import pyarrow as pa

    from vouchspark.operators import corpus as C

    texts = ["skipped", "ab c", "d" * 130, "", "\u00e9 x\u2013y", "\u00e9" * 40, "a \u4e2d", "e"]
    data, edges, starts, ends, chars, odd, long = C._byte_pieces(pa.array(texts).slice(1))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)][:6] == ["ab", "c", "d" * 64, "d" * 64, "dd", "\u00e9"]
    assert odd.tolist() == [False] * 5 + [True, False] and long.tolist() == [False] * 4 + [True, False, False]
    assert chars[edges[4]] - chars[edges[3]] == 5


def test_repeated_chunks_count_together(spark):
    """Rows with one chunk id are one chunk, whether equal or not, and an index analyses its chunks once."""
    rows = [("a", 1, "red fox"), ("a", 1, "red fox"), ("b", 1, "red dog"), ("b", 1, "dog red"), ("c", 1, "blue")]
    chunks = spark.createDataFrame(rows, "chunk_id string, corpus_version long, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "dog")], "query_id long, query string")
    index = R.build_index(chunks)
    small = R.bm25_topk(asked, index, 5)
    many = R.bm25_topk(asked, R.build_index(chunks), 5, broadcast_bytes=0)
    columns = ("query_id", "chunk_id", "rank", "score")
    assert ranked_rows(small, *columns) == ranked_rows(many, *columns)
    kept = index.held["rows"]
    R.bm25_topk(asked.filter("query_id = 2"), index, 5)
    assert index.held["rows"] is kept
    merged = R._merged(spark.createDataFrame([("a", 1, 2, [0, 1], [1, 2]), ("a", 1, 2, [1, 3], [4, 1])], "chunk_id string, corpus_version long, dl int, codes array<int>, tfs array<long>"))
    assert [dict(zip(r.terms, r.tfs, strict=True)) for r in merged.collect()] == [{0: 1, 1: 6, 3: 1}]
