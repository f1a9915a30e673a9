"""The corpus data source and hashes of files."""

import hashlib
import os

import pytest

from vouchspark.sources import corpus_source as CS


def put(path, data=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_skipped_folders_are_never_opened(tmp_path):
    for name in ("a.md", ".git/x.txt", "sub/node_modules/y.md", "sub/b.txt", "sub/c.bin", ".hidden.txt"):
        put(tmp_path / name)
    asked = []

    local = CS.pafs.LocalFileSystem()

    class Fs:
        def get_file_info(self, selector):
            asked.append(os.path.relpath(selector.base_dir, tmp_path))
            return local.get_file_info(selector)

    found = [r for _, r, _ in CS.listed(Fs(), str(tmp_path), True, (".git", "node_modules"))]
    assert found == ["a.md", "sub/b.txt", "sub/c.bin"] and asked == [".", "sub"]
    assert len(list(CS.listed(local, str(tmp_path), True, None))) == 6


def test_partitions_by_size_and_types_left_unread(spark, tmp_path):
    for i in range(12):
        put(tmp_path / f"d{i % 3}/f{i:02d}.txt", b"t" * 400_000)
    put(tmp_path / "d0/picture.png", b"p" * 10)
    if os.geteuid():
        os.chmod(tmp_path / "d0/picture.png", 0)
    df = CS.read_corpus(spark, str(tmp_path), task_bytes=1_000_000)
    assert df.rdd.getNumPartitions() >= 6
    rows = {r.relative: r for r in df.collect()}
    assert len(rows) == 13 and rows["d0/picture.png"].content is None and rows["d0/picture.png"].length == 10
    assert all(len(r.content) == 400_000 for r in rows.values() if r.admitted)
    flat = CS.read_corpus(spark, str(tmp_path / "d1"), recursive=False)
    assert sorted(r.relative for r in flat.collect()) == [f"f{i:02d}.txt" for i in range(1, 12, 3)]


def test_empty_folder(spark, tmp_path):
    assert CS.read_corpus(spark, str(tmp_path)).count() == 0
    assert CS.file_hashes(CS.all_files(spark, str(tmp_path))).count() == 0


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_hashes_by_pieces(spark, tmp_path, piece):
    data = {f"f{i}.bin": os.urandom(1000 * i) for i in range(9)} | {"odd name %20 é.txt": b"z", ".hidden": b"h"}
    for name, content in data.items():
        put(tmp_path / "in" / name, content)
    found = CS.file_hashes(CS.all_files(spark, str(tmp_path / "in")), task_bytes=CS.OPEN_BYTES * 2, piece_bytes=piece)
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.length) for r in found.collect()}
    assert got == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in data.items()}
