import hashlib

import pytest
from pyspark.sql import functions as F

from vouchspark.functions.text import first_title
from vouchspark.operators import corpus as C
from vouchspark.streaming import ingest
from vouchspark.sources import files as FS


def chunks_of(spark, body, **options):
    df = spark.createDataFrame([(1, body)], "doc_id long, text string")
    df = C.with_evidence_id(C.with_sha256(df))
    return [r.asDict() for r in C.chunk_documents(df, **options).orderBy("seq").collect()]


def characters(text):
    return [(i, i + 1) for i in range(len(text))]


def test_blank_text_gives_no_chunks(spark):
    assert chunks_of(spark, "") == [] and chunks_of(spark, "   \n\n ") == []


def test_short_text_is_one_chunk(spark):
    [chunk] = chunks_of(spark, "The quick brown fox.")
    assert (chunk["seq"], chunk["text"], chunk["headings_path"], chunk["token_count"]) == (0, "The quick brown fox.", None, 4)


@pytest.mark.parametrize(
    "body, paths",
    [
        ("# Top\n\nIntro.\n\n## Sub\n\nDetails.", ["Top", "Top > Sub"]),
        ("# A\n\na\n\n## B\n\nb\n\n# C\n\nc", ["A", "A > B", "C"]),
        ("# Real\n\nIntro.\n\n```python\n# not one\n```\n\nMore.", ["Real"]),
        ("before\n### Deep\nx\n# Up\ny", [None, "Deep", "Up"]),
        ("  # indented is text", [None]),
        ("~~~\n# hidden\n~~~\n## Shown\nx", [None, "Shown"]),
    ],
)
def test_heading_paths(spark, body, paths):
    assert [c["headings_path"] for c in chunks_of(spark, body)] == paths


@pytest.mark.parametrize("target, overlap", [(100, 20), (7, 0), (5, 4)])
def test_chunks_are_exact_slices_within_the_target(spark, target, overlap):
    body = "\n  # Section\n\n" + "Lorem ipsum  dolor sit amet. " * 60
    found = chunks_of(spark, body, target=target, overlap=overlap)
    assert [c["seq"] for c in found] == list(range(len(found))) and len(found) >= 2
    for c in found:
        assert body[c["start_offset"]:c["end_offset"]] == c["text"] and c["token_count"] <= target


def test_text_without_blanks_is_cut_and_tiles(spark):
    body = "".join(f"日本語のテキスト第{i}文。絵文字🎉も含まれます。" for i in range(50))
    found = chunks_of(spark, body, target=50, overlap=0)
    assert len(found) > 2 and found[0]["start_offset"] == 0 and found[-1]["end_offset"] == len(body)
    assert all(a["end_offset"] == b["start_offset"] for a, b in zip(found, found[1:]))
    assert "".join(c["text"] for c in found) == body
    long = chunks_of(spark, "x" * 1000, target=5, overlap=0)
    assert [len(c["text"]) for c in long] == [320, 320, 320, 40]


def test_plugged_tokenizer(spark):
    body = "# T\nabcdefghij\n## S\nxyz"
    found = chunks_of(spark, body, target=6, overlap=2, tokenizer=characters)
    assert all(body[c["start_offset"]:c["end_offset"]] == c["text"] for c in found)
    assert [c["seq"] for c in found] == list(range(len(found)))
    assert {c["headings_path"] for c in found} == {"T", "T > S"}


def test_native_windows_match_plugged_windows(spark):
    """The word windows inside Spark equal the Python windows over the same spans."""
    import re

    def words(text):
        return [m.span() for m in re.finditer(r"\S+", text)]

    body = "One two three, four.\nfive six\tseven eight nine ten eleven twelve thirteen"
    native, plugged = chunks_of(spark, body, target=4, overlap=1), chunks_of(spark, body, target=4, overlap=1, tokenizer=words)
    keys = ("text", "token_count", "start_offset", "end_offset")
    assert [[c[k] for k in keys] for c in native] == [[c[k] for k in keys] for c in plugged]


def test_window_arguments():
    for target, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            C.check_window(target, overlap)


def test_titles(spark):
    rows = [("# Hello \nx", "f"), ("x\n  # In\n", "f"), ("none", "f"), ("#no", ""), ("\n" * 60 + "# late", "f"), ("# \n", "f")]
    df = spark.createDataFrame(rows, "t string, f string")
    assert [r[0] for r in df.select(first_title(F.col("t"), F.col("f"))).collect()] == ["Hello", "In", "f", None, "f", "f"]


def test_hot_content_is_reduced_to_its_first_copy(spark):
    """A third of the batch is one text; the result equals a plain Python pass."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}") for i in range(3000)]
    held = spark.createDataFrame([(hashlib.sha256(b"t7").hexdigest(),)], "sha256 string")
    found = {r.doc_id for r in C.new_evidence(spark.createDataFrame(rows, "doc_id long, text string"), held).collect()}
    seen, want = {"t7"}, set()
    for i, text in rows:
        if text not in seen:
            seen.add(text)
            want.add(i)
    assert found == want


def test_rows_without_text_are_named(spark, tmp_path):
    rows = [(1, "a", "s"), (2, None, "s"), (3, None, "s"), (4, "a", "s"), (5, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = C.quarantined(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
    assert sorted(r.doc_id for r in C.new_evidence(df).collect()) == [1, 5]
    ingest.ingest_batch(df, 0, str(tmp_path), target=200, overlap=25)
    assert sorted(r.doc_id for r in ingest.quarantine_table(spark, str(tmp_path)).collect()) == [2, 3]


def test_versions_follow_the_order_and_the_start(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("doc_id")).repartition(7)
    rows = sorted((r.doc_id, r.corpus_version) for r in C.stamp_versions(df, 10).collect())
    assert rows == [(i, i + 11) for i in range(500)]


def test_missing_vectors_and_backfill(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "e1", "x"), ("b", "e1", "yy"), ("c", "e2", "zzz")], "chunk_id string, evidence_id string, text string")
    evidence = spark.createDataFrame([("e1", 3), ("e2", 9)], "evidence_id string, corpus_version long")
    path = str(tmp_path / "vectors")
    spark.createDataFrame([("a", 3, [1.0])], "chunk_id string, corpus_version long, embedding array<float>").write.parquet(path)
    calls = lambda texts: [[float(len(t))] for t in texts]
    for _ in range(2):
        C.backfill(chunks, evidence, path, calls, batch=1)
    rows = sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert rows == [("a", 3, [1.0]), ("b", 3, [2.0]), ("c", 9, [3.0])]


def test_dimension_contract(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<float>")
    row = C.vector_dims(df).first()
    assert (row.min_dim, row.max_dim, row.consistent) == (1, 2, False)
    with pytest.raises(Exception, match="dimension"):
        C.assert_dim(df, 2).collect()


def test_workspace_names(spark):
    names = ["ok-1_x", "", "a" * 64, "a" * 65, "no space", "a/b", "été"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(C.valid_workspace(F.col("n"))).collect()] == [True, False, True, False, False, False, True]


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_corpus_scan(spark, tmp_path):
    write(tmp_path / "a.md", b"# A\nhello \xff world")
    write(tmp_path / "sub/b.txt", "é".encode())
    write(tmp_path / "sub/c.png", b"\x89PNG")
    for skipped in (".git/x.txt", "node_modules/y.md", "sub/.hidden/z.txt", "venv/w.txt"):
        write(tmp_path / skipped, b"no")
    rows = {r.relative: r for r in FS.scan_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.md", "sub/b.txt", "sub/c.png"}
    assert rows["a.md"].text == "# A\nhello � world" and rows["sub/b.txt"].text == "é"
    assert rows["sub/c.png"].admitted is False and rows["sub/c.png"].text is None
    flat = [r.relative for r in FS.scan_corpus(spark, str(tmp_path), recursive=False).collect()]
    assert flat == ["a.md"]
    with pytest.raises(Exception, match="unsupported"):
        FS.scan_file(spark, str(tmp_path / "sub/c.png")).collect()


def test_address_rules_agree_with_the_registry(spark):
    """Literal addresses against Python's own table of special-purpose blocks."""
    import ipaddress

    from vouchspark.sources import documents as SD

    hosts = ["8.8.8.8", "10.1.2.3", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1", "192.168.0.1", "127.0.0.1", "169.254.169.254", "100.63.0.1",
             "100.64.0.1", "100.128.0.1", "0.0.0.0", "224.0.0.1", "240.0.0.1", "255.255.255.255", "198.18.0.1", "198.20.0.1", "203.0.113.9", "192.0.2.1", "1.1.1.1"]
    six = ["::1", "::", "fe80::1", "fc00::1", "ff02::1", "2001:4860:4860::8888", "2001:db8::1", "2606:4700::1111", "2001:200::1"]
    rows = [(h, f"http://{h}/x") for h in hosts] + [(h, f"https://[{h}]:8080/x") for h in six] + [("name", "https://example.org/")]
    df = spark.createDataFrame(rows, "host string, url string").withColumn("body", F.lit("b")).withColumn("mime_type", F.lit("text/html; charset=utf-8"))
    found = {r.host: r.admitted for r in SD.admit_pages(df).collect()}
    want = {}
    for host in [*hosts, *six]:
        ip = ipaddress.ip_address(host)
        want[host] = ip.is_global and not (ip.is_multicast or ip.is_reserved)
    assert found == {**want, "name": True}


def test_page_rules_in_order(spark):
    from vouchspark.sources import documents as SD

    rows = [("ftp://u:p@10.0.0.1/", "b", "text/plain"), ("http://u@example.org/", "b", "text/plain"), ("http:///x", "b", "text/plain"),
            ("HTTPS://Example.org", "b", "image/png"), ("https://example.org", "b" * 30, "application/json"), ("nonsense", "b", "text/plain")]
    df = spark.createDataFrame(rows, "url string, body string, mime_type string")
    assert [r.reason for r in SD.admit_pages(df).collect()] == ["scheme", "credentials", "no host", "unsupported type", None, "scheme"]
