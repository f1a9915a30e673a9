"""Token files and packing: exact round trips, edge rows."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vouchspark.llm import bpe, packing, token_files
from vouchspark.llm.storage import shared_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "a  b\n\n c \t", "'' 's don't  ", "\x1c a\x1f b", "Σ ΣΑΣ é́ ́a İstanbul", "x" * 300, "  hi there　 ok  ", "<|endoftext|> foo<|endoftext|>bar",
    "a 's'S 'sd 12 345x", "\n\n\nfoo   bar\r\n", "", " ", "Straße, naïve; слово: 語!", "word, word. word", "²½Ⅷ a² 5a", "é́" * 40, None,
]
SCHEMA = "doc_id long, text string, size int, n_tokens string"


def rows():
    return [(i * 3, t, i, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 0, "x"), (3, "second text of an id", 0, None), (3, "'' 's don't  ", 0, None), (999, "long words " * 40_000, 0, "")]


def ids(path, text):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "bare"), [(BYTE, False), (WORD, True)])
def test_units_give_the_library_s_ids(path, bare):
    enc = bpe.UnitEncoder(path, bare)
    for _ in range(2):
        for text in TEXTS:
            assert enc.encode(text) == array("I", ids(path, text)).tobytes(), text
    enc.known, enc.older = {}, dict(enc.known)
    assert enc.encode(TEXTS[5]) == array("I", ids(path, TEXTS[5])).tobytes()


@pytest.mark.parametrize(("path", "bare"), [(BYTE, False), (WORD, True)])
def test_cut_units_give_the_library_s_ids(path, bare):
    enc, rng = bpe.UnitEncoder(path, bare), random.Random(2)
    assert enc.cuts
    letters = "ab \n\tZé.ß,'!<|>$#_Σσ́ İ1語 ×ẞ$"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts += ["x<|endoftext|>", "x<|endoftext|>,", "<|startoftext|> a.", "it's, don't' we'll!", "\nword.", "\n Word", "\r\nword#", "été... Straße''s'", "x İ$$ İ."]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    for text in texts:
        assert enc.encode(text) == array("I", tok.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    folder = shared_folder(spark, "test")
    manifest = token_files.write_token_files(docs, folder, BYTE)
    got = sorted(((r["doc_id"] is not None, r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest, folder).collect())
    key = lambda r: (r[0] is not None, r[0] or 0)
    want, at = [], 0
    expect = {}
    for doc_id, text, *_ in rows():
        raw = array("I", [*ids(BYTE, text), 2]).tobytes()
        expect.setdefault(doc_id, []).append((len(raw) // 4, zlib.crc32(raw)))
    assert [g[0][1] for g in got] == [r[0] for r in sorted(rows(), key=key)]
    for (_, doc_id), start, n, crc in got:
        assert start == at and (n, crc) in expect[doc_id]
        at += n
        want.append((n, crc))
    assert sorted(want) == sorted(x for v in expect.values() for x in v)


def test_single_documents_and_damage(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    folder = shared_folder(spark, "test")
    manifest = token_files.write_token_files(docs, folder, BYTE)
    found = token_files.read_documents(manifest, folder, spark.createDataFrame([(9,), (3,), (12345,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in found) == [3, 3, 3, 9]
    assert next(list(r["ids"]) for r in found if r["doc_id"] == 9) == [*ids(BYTE, TEXTS[3]), 2]
    path = str(tmp_path / "x.ztok")
    with open(path, "wb") as out:
        writer = token_files.TokenFileWriter(out)
        for k in range(3):
            writer.add(k, np.arange(100 * (k + 1), dtype="<u4").tobytes())
        writer.close()
    fs, at = token_files.open_folder(path)
    file = token_files.TokenFile(fs, at)
    assert len(file) == 3 and file.lengths().tolist() == [100, 200, 300] and file.find(1) == [1] and file.find(7) == []
    assert file.document(2) == np.arange(300, dtype="<u4").tobytes()
    raw = bytearray(open(path, "rb").read())
    raw[int(file.at[1]) + 12] ^= 255
    open(path, "wb").write(bytes(raw))
    broken = token_files.TokenFile(fs, at)
    assert broken.document(0) == file.document(0)
    with pytest.raises(Exception):  # noqa: B017
        broken.document(1)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True)
    assert whole.read(400) == np.arange(100, dtype="<u4").tobytes()


def test_empty_table_of_tokens(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_files.token_files(none, BYTE).count() == 0
    assert packing.packed_documents(none, WORD).count() == 0


def best_sum(lengths, capacity):
    """Sum of squares, bin by bin."""
    gaps, placed = [], []
    for n in sorted(lengths, reverse=True):
        options = []
        for k, g in enumerate([*gaps, capacity]):
            if g >= n:
                after = [x for i, x in enumerate(gaps) if i != k] + [g - n]
                counts = {}
                for x in after:
                    if x:
                        counts[x] = counts.get(x, 0) + 1
                options.append((sum(c * c for c in counts.values()), k == len(gaps), g, k))
        best = min(options)
        placed.append(best[0])
        gaps = [x for i, x in enumerate(gaps) if i != best[3]] + [best[2] - n]
    return placed[-1], len(gaps)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 21, size=rng.integers(1, 40))
        bins, offsets = packing.sum_of_squares_bins(lengths, 20)
        gaps = 20 - np.bincount(bins, weights=lengths).astype(int)
        assert (gaps >= 0).all()
        left = np.bincount(gaps[gaps > 0])
        assert (int((left * left).sum()), len(gaps)) == best_sum(lengths.tolist(), 20)
        for b in range(len(gaps)):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]


def test_packed_documents(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = packing.packed_documents(docs, WORD, capacity=4096).collect()
    expect = []
    for doc_id, text, *_ in rows():
        raw = array("I", [*ids(WORD, text), 1]).tobytes()
        for k in range(-(-len(raw) // (4 * 4096))):
            part = raw[4 * 4096 * k : 4 * 4096 * (k + 1)]
            expect.append((doc_id is None, doc_id or 0, k, 4096 * k, len(part) // 4, zlib.crc32(part)))
    assert sorted((r[0] is None, r[0] or 0, *r[1:5]) for r in got) == sorted(expect)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 4096) + 1
