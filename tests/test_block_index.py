"""Stored index in blocks: bounds, skipped blocks, batches and compaction."""

from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vouchspark.operators import block_index as S
from vouchspark.operators import retrieval as R
from vouchspark.plans import derived as D

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    R.write_index(R.build_index(D.ch(spark, FOLDER)), path, buckets=4)
    return path


def test_peaks_are_the_largest_gains(spark, stored):
    index = R.read_index(spark, stored)
    avgdl = index.totals.first()["avgdl"]
    posts = index.blocks.select("block", "dls", F.explode(F.arrays_zip("codes", "places", "tfs")).alias("p"))
    posts = posts.select("block", F.col("p.codes").alias("code"), F.col("p.tfs").alias("tf"), F.get("dls", F.col("p.places")).alias("dl"))
    found = posts.groupBy("block", "code").agg(F.max(S.gain(F.col("tf"), F.col("dl"), avgdl)).alias("want"), F.count(F.lit(1)).alias("m"))
    both = found.join(index.bounds, ["block", "code"], "full")
    assert both.filter("want is null or peak is null or abs(want - peak) > 1e-9 or m <> n").count() == 0


def test_words_are_numbered_once(spark, stored):
    words = spark.read.parquet(f"{stored}/words")
    assert words.count() == words.select("code").distinct().count() == words.select("word").distinct().count()
    assert words.agg(F.max("code") - F.min("code") + 1).first()[0] == words.count()


def test_share_of_blocks_skipped(spark, stored, monkeypatch):
    """On the given data: (query, block) pairs that are scored after the first pass, for the best ten."""
    index, asked, scored = R.read_index(spark, stored), [], S.scored

    def counted(index, pairs, *args, **options):
        asked.append(pairs.agg(F.sum(F.size("queries"))).first()[0])
        return scored(index, pairs, *args, **options)

    monkeypatch.setattr(S, "scored", counted)
    queries = D.questions(spark, FOLDER)
    found = R.bm25_topk(queries, index, 10).count()
    every = index.blocks.count() * queries.count()
    assert found == 400 and len(asked) == 2
    assert asked[0] < 0.05 * every and 0 < asked[1] < 0.75 * every


def test_batches_and_compaction_answer_the_same(spark, tmp_path):
    rows = [(f"c{i:03d}", i % 5 + 1, " ".join(["running" if i % 3 else "runs"] + [f"w{(i * k) % 17}" for k in range(i % 9)])) for i in range(90)] + [("empty", 1, "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, corpus_version long, text string")
    queries = spark.createDataFrame([(1, "run w3 w5", 2), (2, "runner w16", None), (3, "nothing", 3)], "query_id long, query string, as_of long")
    fresh = R.build_index(chunks, stem=True)
    for batch, low in enumerate((0, 40, 80)):
        part = chunks.filter((F.col("chunk_id") >= f"c{low:03d}") & (F.col("chunk_id") < f"c{low + 40:03d}") | ((F.col("chunk_id") == "empty") & F.lit(batch == 2)))
        R.write_index(R.build_index(part, stem=True), f"{tmp_path}/parts", buckets=2, batch=batch)
    R.compact_index(spark, f"{tmp_path}/parts", f"{tmp_path}/whole")
    for options in ({}, {"version_per_query": True}, {"corpus_version": 3, "stats_scope": "snapshot"}):
        want = sorted(tuple(r) for r in R.bm25_topk(queries, fresh, 7, **options).select("query_id", "chunk_id", "rank", "score").collect())
        assert want
        for folder in ("parts", "whole"):
            got = R.bm25_topk(queries, R.read_index(spark, f"{tmp_path}/{folder}"), 7, **options)
            assert sorted(tuple(r) for r in got.select("query_id", "chunk_id", "rank", "score").collect()) == want
    whole = R.read_index(spark, f"{tmp_path}/whole")
    assert whole.totals.count() == 1 and whole.blocks.count() <= -(-91 // S.BLOCK) + 8


def test_reach_bounds_every_score():
    import pandas as pd

    rng = np.random.default_rng(2)
    weights = S.Weights(pd.DataFrame({"query_id": list("aabbc"), "code": [1, 3, 3, 9, 4], "weight": rng.random(5), "until": [None] * 5}))
    codes, places, tfs = np.array([1, 1, 3, 5, 9]), np.array([0, 2, 1, 1, 2]), np.array([2, 1, 4, 1, 3])
    dls = np.array([5, 7, 9])
    first = np.array([0, 2, 3, 4])
    peaks = np.maximum.reduceat(S.gain(tfs.astype(float), dls[places].astype(float), 6.0), first)
    known = np.isin(codes[first], weights.codes)
    reach = weights.reach([codes[first][known]], [peaks[known]])
    scorer = S.BlockScorer(weights, 3, 6.0, np.inf)
    scorer.feed(np.arange(3), np.array(["x", "y", "z"]), np.array([1, 1, 1]), dls, codes, places, tfs)
    for query, best in scorer.frame().groupby("query_id")["score"].min().items():
        assert -best <= reach[0]["abc".index(query)] + S.MARGIN


def test_words_of_texts_are_not_stored_as_rows(spark, tmp_path, monkeypatch):
    """The placed texts are written in columns, and go once the batch is whole."""
    kept, checkpoint = [], S.reliable_checkpoint
    monkeypatch.setattr(S, "reliable_checkpoint", lambda df: kept.append(df.columns) or checkpoint(df))
    chunks = spark.createDataFrame([(f"c{i}", 1, "one two two") for i in range(20)], "chunk_id string, corpus_version long, text string")
    R.write_index(R.build_index(chunks, stem=True), str(tmp_path), buckets=2)
    assert kept and not any("tokens" in columns for columns in kept)
    assert not (Path(tmp_path) / "placed").exists()


def test_reach_is_taken_for_a_few_blocks_at_once():
    """However many blocks Spark puts into one frame."""
    frame = pd.DataFrame({"block": np.arange(5000), "codes": [np.array([1])] * 5000, "peaks": [np.array([1.0])] * 5000})
    sizes = []

    def reach(codes, peaks):
        sizes.append(len(codes))
        return np.ones((len(codes), 3))

    sent = SimpleNamespace(value=SimpleNamespace(query_ids=np.arange(3), reach=reach))
    local = SimpleNamespace(mapInPandas=lambda run, schema: pd.concat(run(iter([frame]))))
    found = S.survivors(local, sent, np.zeros(3))
    assert max(sizes) <= 1000 and found["block"].tolist() == list(range(5000))


def test_a_word_is_named_once_a_page(monkeypatch):
    """What is joined with the vocabulary is the distinct words of a page; pages are of whole blocks."""
    monkeypatch.setattr(S, "PAGE_WORDS", 50)
    texts = [["a"] * (i % 4) + ["b", f"w{i // 20}"] for i in range(90)] + [[], ["a"]]
    rows = pa.table({
        "block": pa.array([i // 8 for i in range(92)], pa.int64()), "place": pa.array([i % 8 for i in range(92)], pa.int32()), "chunk_id": [f"c{i:02d}" for i in range(92)],
        "corpus_version": pa.array([1] * 92, pa.int64()), "dl": pa.array([len(t) for t in texts], pa.int32()), "tokens": texts, "tfs": pa.array([None] * 92, pa.list_(pa.int32())),
    })
    made = [r for batch in S.pages(iter(rows.to_batches(max_chunksize=30))) for r in batch.to_pylist()]
    assert [r["block"] for r in made] == list(range(12)) and 3 < len({r["page"] for r in made}) < 12
    named = {r["page"]: r["words"] for r in made if r["words"] is not None}
    assert set(named) == {r["page"] for r in made} and all(len(set(words)) == len(words) for words in named.values())
    assert sum(map(len, named.values())) < sum(map(len, texts)) / 4
    found = {(8 * r["block"] + at, named[r["page"]][word]): tf for r in made for word, at, tf in zip(r["locals"], r["places"], r["tfs"], strict=True)}
    assert found == {(i, word): text.count(word) for i, text in enumerate(texts) for word in text}
    assert [c for r in made for c in r["chunk_ids"]] == rows["chunk_id"].to_pylist()


def test_words_too_many_to_send_are_no_rows(spark, tmp_path, monkeypatch):
    """Where the vocabulary is not broadcast, a row is still a distinct word of a page."""
    sent, measured = [], S.fits_broadcast
    monkeypatch.setattr(S, "fits_broadcast", lambda df: bool(measured(df)) and not {"word", "term"} & set(df.columns))
    monkeypatch.setattr(S, "placed", lambda docs, path, batch, real=S.placed: sent.append(real(docs, path, batch)) or sent[-1])
    remove = S.remove_folders
    monkeypatch.setattr(S, "remove_folders", lambda spark, paths: None)
    rows = [(f"c{i:03d}", 1, " ".join(["running", "runs"] * 20 + [f"w{i % 3}"])) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, corpus_version long, text string")
    for batch in range(2):
        R.write_index(R.build_index(chunks.filter(F.col("chunk_id") >= "c100" if batch else F.col("chunk_id") < "c100"), stem=True), f"{tmp_path}/parts", buckets=2, batch=batch)
    R.compact_index(spark, f"{tmp_path}/parts", f"{tmp_path}/whole")
    monkeypatch.setattr(S, "remove_folders", remove)
    assert len(sent) == 3 and all(p.filter("words is not null").agg(F.sum(F.size("words"))).first()[0] <= 5 * 8 for p in sent)
    index = R.read_index(spark, f"{tmp_path}/whole")
    terms = {r["code"]: r["term"] for r in index.terms.collect()}
    posts = [(c, terms[code], tf) for r in index.blocks.collect() for code, at, tf in zip(r["codes"], r["places"], r["tfs"], strict=True) for c in [r["chunk_ids"][at]]]
    assert sorted(posts) == sorted([(c, "run", 40) for c, _, _ in rows] + [(f"c{i:03d}", f"w{i % 3}", 1) for i in range(200)])
    assert sorted((r["term"], r["df"]) for r in index.terms.collect()) == [("run", 200), ("w0", 67), ("w1", 67), ("w2", 66)]


def test_rows_of_one_chunk_share_their_words_when_compacted(spark, tmp_path):
    rows = [("a", 1, "one two"), ("a", 1, "one two"), ("b", 1, "two"), ("b", 2, "three")]
    for batch, part in enumerate((rows[:3], rows[3:])):
        R.write_index(R.build_index(spark.createDataFrame(part, "chunk_id string, corpus_version long, text string")), f"{tmp_path}/parts", buckets=2, batch=batch)
    R.compact_index(spark, f"{tmp_path}/parts", f"{tmp_path}/whole")
    index = R.read_index(spark, f"{tmp_path}/whole")
    terms = {r["code"]: r["term"] for r in index.terms.collect()}
    posts = [(c, v, terms[code], tf) for r in index.blocks.collect() for code, at, tf in zip(r["codes"], r["places"], r["tfs"], strict=True) for c, v in [(r["chunk_ids"][at], r["versions"][at])]]
    assert sorted(posts) == [("a", 1, "one", 2), ("a", 1, "one", 2), ("a", 1, "two", 2), ("a", 1, "two", 2), ("b", 1, "three", 1), ("b", 1, "two", 1), ("b", 2, "three", 1), ("b", 2, "two", 1)]
