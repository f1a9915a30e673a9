"""Benchmark decontamination against brute force; suffix arrays; edges."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vouchspark.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def windows_of(words, window):
    n = min(window, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words, hit, named = words_of(text), set(), set()
        for item_id, item in items:
            own = set(windows_of(words_of(item), window))
            n = len(next(iter(own))) if own else 0
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in own:
                    hit |= set(range(i, i + n))
                    if item_id is not None:
                        named.add(str(item_id))
        out.append((doc_id, len(words), len(hit), sorted(named), bool(hit)))
    return sorted(out, key=str)


def brute_matches(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        a = words_of(text)
        for item_id, item in items:
            b = words_of(item)
            n = min(window, len(b))
            for i in range(len(a)):
                for j in range(len(b)):
                    if n and a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                        k = 0
                        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                            k += 1
                        if k >= n:
                            out.append((doc_id, item_id, i, j, k))
    return sorted(out, key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: ["der", "Straße", "naïve", "the", "of", "x1", "語", "tok"][rng.integers(8)] + str(rng.integers(3))
    items = [(i, " ".join(word() for _ in range(rng.integers(1, 40)))) for i in range(30)]
    items += [(3, items[4][1]), (None, " ".join(word() for _ in range(15))), (50, None), (51, ""), (52, "?! ."), (53, items[0][1]), (54, "loop " * 14)]
    docs = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.integers(0, 60)))]
        if i % 3 == 0:
            own = words_of(items[rng.integers(30)][1])
            at = rng.integers(0, max(1, len(own) - 11))
            parts.append("-".join(own[at : at + rng.integers(8, 30)]).upper() if i % 2 else ", ".join(own))
        docs.append((i, "\n".join([*parts, " ".join(word() for _ in range(5))])))
    docs += [(200, None), (201, ""), (202, "\x01 \x00 !"), (203, "loop " * 40), (204, items[33][1] if items[33][1] else ""), (None, items[5][1]), *docs[:3]]
    docs += [(300 + i, docs[0][1]) for i in range(40)]  # a hot group of copies of a contaminated text
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500, "shard_words": 200}, {"window": 4}])
def test_measure_and_matches_against_brute_force(spark, options):
    docs, items = corpus(1)
    window = options.get("window", 10)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("item_id", F.lit(3)).withColumn("_text", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(1))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in D.measure(df.drop("_text"), bench, **options).collect()), key=str)
    assert got == brute(docs, items, window)
    distinct = list(dict.fromkeys(items))
    assert sorted((tuple(r) for r in D.matches(df, bench, **options).collect()), key=str) == brute_matches(docs, distinct, window)
    kept = D.clean_documents(df, bench, **options)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute(docs, items, window) if not r[4]), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in D.measure(docs, none).collect()) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert D.measure(docs.limit(0), none).count() == 0 and D.matches(docs, none).count() == 0
    assert D.measure(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_very_long_text(spark):
    text = "far " * 400_000 + "one two three four five six seven eight nine ten eleven " + "far " * 400_000
    docs = spark.createDataFrame([(1, text), (2, "a" * 9_000_000 + " b")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "zero one two three four five six seven eight nine ten eleven twelve")], "item_id string, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in D.measure(docs, bench).collect()) == [(1, 800_011, 11, ["q"]), (2, 2, 0, [])]
    assert [tuple(r) for r in D.matches(docs, bench).collect()] == [(1, "q", 400_000, 1, 11)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 4))
def test_suffix_array_and_ranges(codes, least):
    codes = np.array(codes, dtype=np.int32)
    suffixes = D.suffix_array(codes, least, 4)
    full = [i for i in range(len(codes)) if i + least <= len(codes) and (codes[i : i + least] > 0).all()]
    assert sorted(suffixes.tolist()) == full
    padded = np.concatenate([codes, np.zeros(4, dtype=np.int32)])
    windows = np.array([[a, b, c, d][:least] for a in (1, 2, 3) for b in (1, 2) for c in (1, 3) for d in (2, 3)], dtype=np.int32)
    lo, hi = D.ranges(padded, suffixes, windows)
    for w, x, y in zip(windows, lo, hi, strict=True):
        assert sorted(suffixes[x:y].tolist()) == [i for i in full if (codes[i : i + least] == w).all()]
