"""Fill-in-the-middle: piece tables, exact round trips, edges."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vouchspark.llm import middle

ROWS = [
    (1, "plain words of a text"), (2, ""), (3, None), (None, "a row without an id"), (4, "holds <S> already"), (5, "Straße und 語 mixed é́ 🤦🏼‍♂️"),
    (5, "Straße und 語 mixed é́ 🤦🏼‍♂️"), (6, "x"), (7, "word " * 60_000), (8, "\x00 zero byte"), *[(i, f"document number {i} " * (i % 7 + 1)) for i in range(20, 220)],
]


def expected(doc_id, text):
    """By slices of Python strings."""
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not n or doc_id is None or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_transform_against_slices_and_back(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    made = middle.transform(df, digests=True)
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in made.collect()), key=key)
    want = []
    for i, t in ROWS:
        n, form, pre, mid, out = expected(i, t)
        want.append((i, n, form, pre, mid, out, sha(out), sha(t or "")))
    assert got == sorted(want, key=key)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    back = sorted(((r.doc_id, r.text) for r in middle.restore(made).collect()), key=key)
    assert back == sorted(((i, t or "") for i, t in ROWS), key=key)


def test_pieces_write_the_output(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] is not None and r[1]], "doc_id long, text string").distinct()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in middle.transform(docs).collect():
        buffers = (texts[r.doc_id], middle.SENTINELS)
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode() == r.output
        assert r.output_sha256 is None


def test_empty_table_and_rates(spark):
    assert middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(i, "some text here") for i in range(300)], "doc_id long, text string")
    assert {r.form for r in middle.transform(docs, part=0).collect()} == {"plain"}
    assert {r.form for r in middle.transform(docs, part=100, suffix_first=100).collect()} == {"spm"}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.integers(0, 41), st.integers(0, 41), st.sampled_from(["psm", "spm"]))
def test_inverse_permutation(text, a, b, form):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    raw = text.encode("utf-8", "surrogatepass")
    size = lambda k: len(text[:k].encode("utf-8", "surrogatepass"))
    table = middle.PieceTable(raw)
    table.cut(size(a), size(b))
    out = table.arranged(form).written()
    assert middle.restored_text(out, form).written() == raw


def test_damaged_output_is_an_error():
    with pytest.raises(ValueError):
        middle.restored_text(b"no sentinels", "psm")
