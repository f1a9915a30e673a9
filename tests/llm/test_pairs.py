"""Jaccard join and vector dedup against brute force, hot groups included."""

import numpy as np
from pyspark.sql import functions as F

from vouchspark.llm import graph, jaccard_join, vector_dedup


def sets_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def smallest(nodes, links):
    own = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(own[a], own[b])
            if own[a] != low or own[b] != low:
                own[a] = own[b] = low
                changed = True
    return own


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    links = [
        (a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    own = smallest({i for i, _ in rows if i is not None}, links)
    return sorted((i is None, i or 0, len(s), -1 if i is None else own[i]) for i, s in sets)


def corpus(rng, n, vocabulary=3000):
    word = lambda: f"w{rng.integers(vocabulary)}"
    passage = [word() for _ in range(60)]
    rows, made = [], []
    for i in range(n):
        kind = rng.random()
        if made and kind < 0.55:
            words = list(made[rng.integers(min(len(made), 6))])
            for _ in range(rng.integers(0, 5)):
                words[rng.integers(len(words))] = word()
            words = words[: len(words) - int(rng.integers(0, 12))]
        else:
            words = [word() for _ in range(rng.integers(20, 160))]
            if kind > 0.8:
                words = words[:25] + passage + words[25:]
            made.append(words)
        rows.append((i, " ".join(words)))
    return rows


def check(spark, rows, **limits):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("component_id", F.lit(7))
    got = sorted((r[0] is None, r[0] or 0, r[1], -1 if r[2] is None else r[2]) for r in jaccard_join.jaccard_components(df.repartition(3)).collect())
    assert got == brute(rows)


def test_join_equals_brute_force(spark):
    check(spark, corpus(np.random.default_rng(3), 260))


def test_join_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 4)
    check(spark, corpus(np.random.default_rng(8), 200, 400))


def test_chains_around_the_threshold(spark):
    base = [f"b{k}" for k in range(104)]
    rows = []
    for i in range(60):
        words = list(base)
        words[2 + 5 * (i % 20)] = f"x{i}"
        words[4 + 5 * (i // 3 % 20)] = f"y{i // 2}"
        rows.append((i, " ".join(words)))
    check(spark, rows)


def test_join_edges(spark):
    text = "a B c d e f g h i j k l m n o p"
    rows = [
        (5, text), (5, text), (9, text.upper()), (None, text), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (6, "One  TWO"), (7, "one two three"),
        (8, "É é e f"), (10, "é é e f"), (11, "long text " * 30_000), (12, "long text " * 29_000), (13, "x y z u v"), (14, "x y z u v w"),
    ]
    check(spark, rows)
    check(spark, [(1, None)])
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(len(x) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        a, b = jaccard_join._band(len(x)), jaccard_join._band(len(y))
        assert abs(a - b) <= 1
        words = jaccard_join.bitmap_bits(max(a, b), jaccard_join.THIN) // 64
        import pyarrow as pa

        m = jaccard_join._matrix(pa.array([jaccard_join.bitmap(x, jaccard_join.THIN), jaccard_join.bitmap(y, jaccard_join.THIN)]), words)
        assert jaccard_join.can_link(len(x), len(y), int(np.bitwise_count(m[0] ^ m[1]).sum()))


def test_narrow_bitmaps_rule_out_unrelated_sets():
    rng = np.random.default_rng(1)
    for n in (80, 250, 900, 4000):
        x, y = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        x_map, y_map = jaccard_join.bitmap(x, jaccard_join.LOAD), jaccard_join.bitmap(y, jaccard_join.LOAD)
        # Tiles carry them once per token and row.
        assert len(x_map) * 8 <= 4 * n
        assert not jaccard_join.can_link(len(x), len(y), jaccard_join._differing(x_map, y_map))


def test_pivots_of_several_orders_meet_at_once(spark):
    rows = spark.createDataFrame([(1, i, 0, i) for i in (3, 4, 5, 6)], "token long, doc_id long, band int, label long")
    got = jaccard_join.pivot_pairs(rows, F.struct("doc_id"), F.struct(-F.col("doc_id"))).collect()
    assert sorted(map(tuple, got)) == [(3, 4), (3, 5), (3, 6), (4, 6), (5, 6)]


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    want = smallest({x for pair in links for x in pair if pair[0] != pair[1]}, [p for p in links if p[0] != p[1]])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(rng, n, dim=24):
    rows, base = [], rng.normal(size=(5, dim))
    for i in range(n):
        kind = rng.random()
        v = base[rng.integers(5)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3, 0.4]) if kind < 0.6 else rng.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if kind < 0.95 else None))
    return rows


def brute_vectors(rows, threshold):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    out, links = [], []
    for k, (a, v, la) in enumerate(rows):
        n = 0
        for j, (b, w, lb) in enumerate(rows):
            if j != k and a is not None and b is not None and la is not None and la == lb and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n += 1
                    links.append((a, b))
        out.append((a, n))
    own = smallest({a for a, _ in out if a is not None}, links)
    return sorted((a is None, a or 0, n, -1 if a is None else own[a], a is not None and own[a] == a) for a, n in out)


def run_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("clash"))
    return sorted((r[0] is None, r[0] or 0, r[1], -1 if r[2] is None else r[2], r[3]) for r in vector_dedup.vector_components(df.repartition(3)).collect())


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 16)
    rows = vectors(np.random.default_rng(5), 220)
    assert run_vectors(spark, rows) == brute_vectors(rows, 0.93)


def test_vector_edges(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (None, one, 1), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None, 3.0], 1),
            (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [2.0, 4.0, 6.0], 1), (12, [1.0, 2.0], 1), (13, [1e-30, 2e-30, 3e-30], 1), (14, [-1.0, -2.0, -3.0], 1)]
    assert run_vectors(spark, rows) == brute_vectors(rows, 0.93)
    assert vector_dedup.vector_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    u, v = vector_dedup.units(rng.normal(size=(300, 64))), vector_dedup.units(rng.normal(size=(200, 64)) ** 3)
    bound = vector_dedup.upper_bounds(*vector_dedup.quantised(u), *vector_dedup.quantised(v))
    exact = u @ v.T
    assert (bound >= exact).all() and (bound - exact).max() < 0.12


def test_join_sends_small_batches_and_restores_the_setting(spark, monkeypatch):
    from vouchspark.llm import jaccard_join
    from vouchspark.llm.worker import BATCH_ROWS

    seen, made = [], jaccard_join.sketches
    monkeypatch.setattr(jaccard_join, "sketches", lambda *a: seen.append(spark.conf.get(BATCH_ROWS)) or made(*a))
    before = spark.conf.get(BATCH_ROWS, None)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    found = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    assert found == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]
    assert seen == ["1000"] and spark.conf.get(BATCH_ROWS, None) == before
