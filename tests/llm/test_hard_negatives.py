"""Hard negatives against brute force, exact products of every width, edges."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vouchspark.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>"
INF = float("inf")


def whole(x):
    return math.floor(256 * x) if abs(x) < 1e15 else 256 * int(x)


def brute(rows, every=100, positives=5, negatives=5, least=80):
    fine = {
        (i, y, tuple(whole(x) for x in e)) for i, y, e in rows
        if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    }
    out = []
    for a, la, va in fine:
        if a % every:
            continue
        scored = {(s, i, y == la) for i, y, v in fine if i != a and len(v) == len(va) for s in [max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(va, v, strict=True))))]}
        best = sorted((-s, i) for s, i, same in scored if same)[:positives]
        for s, i in best:
            hard = sorted((-t, j) for t, j, same in scored if not same and least * -s <= 100 * t <= 100 * -s)[:negatives]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(hard)]
    return sorted(out)


def found(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).withColumn("a", F.lit(1)).repartition(parts)
    return sorted(tuple(r) for r in H.mine(df, **options).collect())


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_products_are_exact(data):
    dim, top = data.draw(st.integers(0, 9)), 1 << data.draw(st.sampled_from([1, 8, 12, 20, 30, 62, 200]))
    line = st.lists(st.integers(-top, top), min_size=dim, max_size=dim)
    a, b = data.draw(st.lists(line, min_size=1, max_size=4)), data.draw(st.lists(line, min_size=1, max_size=7))
    kind = object if top >= 1 << 62 else np.int64
    got = H.scores(np.array(a, dtype=kind).reshape(len(a), dim), np.array(b, dtype=kind).reshape(len(b), dim))
    want = [[max(H.LOWEST, min(H.HIGHEST, sum(x * y for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
    assert got.tolist() == want


def test_components_wider_than_their_products():
    assert H.scores(np.array([[0]], dtype=object), np.array([[0], [256]], dtype=object)).tolist() == [[0, 0]]


def test_large_constant_components():
    # Nothing varies, so one bit would do for a field, but the sums are beyond a long.
    a = np.full((2, 9), 1 << 30)
    assert H.scores(a, np.concatenate([a, -a])).tolist() == [[H.HIGHEST] * 2 + [H.LOWEST] * 2] * 2


def test_fields_do_not_touch():
    # The largest sums that a field must hold, side by side with empty ones.
    a = np.full((2, 64), 256)
    b = np.array([[256] * 64, [-256] * 64, [0] * 64, [256] * 64, [-256] * 64])
    assert H.field_bits(64, 512, 512) * 2 <= H.DOUBLE_BITS
    assert H.scores(np.concatenate([a, -a]), b).tolist() == [[4194304 * s * t for t in (1, -1, 0, 1, -1)] for s in (1, 1, -1, -1)]


@pytest.mark.parametrize("anchor_bytes", [H.ANCHOR_BYTES, 2000])
def test_mine_against_brute_force(spark, anchor_bytes):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 8))
    rows = [(int(i), int(rng.integers(4)), [float(x) for x in centre[rng.integers(4)] + rng.normal(size=8) * 0.3]) for i in range(600)]
    rows += [(i + 600, 1, rows[0][2]) for i in range(200)]  # a hot group of copies, anchors among them
    rows += rows[:5] + rows[95:105] + [(100, 2, rows[7][2]), (100, 3, rows[8][2])]  # repeated rows, an id with several vectors
    assert found(spark, rows, anchor_bytes=anchor_bytes) == brute(rows)


def test_edges(spark):
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [0.5, 2.0]), (2, 2, [0.5, 1.9]), (3, 2, [1.0, float("nan")]), (4, 2, [1.0, None]), (5, 2, None), (6, None, [1.0, 1.0]),
        (None, 2, [1.0, 2.0]), (7, 2, [INF, 1.0]), (8, 2, [1.0]), (100, 2, []), (101, 2, []), (102, 3, []), (200, 1, [1e300, -1e10]), (201, 2, [1e290, 5.0]),
        (202, 1, [1e300, 0.0]), (203, 1, [3e4, 1.0]), (204, 2, [3e4, 1.0]), (300, 1, [0.0, 0.0]), (301, 2, [-0.0, 0.0]), (-100, 1, [5000.0, 5000.0]), (-101, 2, [5000.0, 4990.0]),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []
    assert found(spark, [(0, 1, [1.0]), (2, 2, [1.0])]) == []


def test_other_settings(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(2)), [float(x) for x in rng.integers(0, 3, 4)]) for i in range(120)]
    options = {"every": 10, "positives": 3, "negatives": 2, "least": 50}
    assert found(spark, rows, **options) == brute(rows, **options)
