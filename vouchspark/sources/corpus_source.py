"""Corpus folders as a Spark data source, and hashes of files of any size.

``spark.read.format("corpus")`` lists a folder without entering skipped ones, packs the files by size
into partitions, and opens only files of an admitted type.  ``file_hashes`` reads files piece
by piece, so that no file has to fit into a row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vouchspark.operators.scaling import running_sums

SCHEMA = "path string, relative string, length long, mime_type string, admitted boolean, content binary"
#: Bytes of files that one task reads, and of a piece of a file that is hashed.
TASK_BYTES, PIECE_BYTES = 64 * 1024 * 1024, 8 * 1024 * 1024
#: A file weighs at least this much: opening it takes time as well.
OPEN_BYTES = 256 * 1024


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a place that all executors reach: a URI or a plain path."""
    local = re.sub(r"\Afile:/*", "/", uri)
    if local.startswith("/"):
        return pafs.LocalFileSystem(), local
    scheme, _, rest = uri.partition("://")
    host, _, path = rest.partition("/")
    fs, base = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
    return fs, f"{base.rstrip('/')}/{path}"


@dataclass
class Files(InputPartition):
    """Files of one task: (path, relative, length, mime_type, admitted)."""

    files: list[tuple[str, str, int, str, bool]]


def listed(fs: pafs.FileSystem, root: str, recursive: bool, skipped: tuple[str, ...] | None) -> Iterator[tuple[str, str, int]]:
    """(path, relative, length) of files, sorted by folder and name; hidden and skipped folders are
    not entered, files whose name starts with a dot or is a skipped one are left out.  Without
    ``skipped`` everything is listed."""
    waiting = [root]
    while waiting:
        folder = waiting.pop()
        inside = sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda f: f.base_name)
        kept = [f for f in inside if skipped is None or not (f.base_name.startswith(".") or f.base_name in skipped)]
        for info in kept:
            if info.type == pafs.FileType.File:
                yield info.path, info.path[len(root) :].lstrip("/"), info.size
        if recursive:
            waiting += [f.path for f in reversed(kept) if f.type == pafs.FileType.Directory]


def packed(files: list[tuple], limit: int) -> list[Files]:
    """Files in partitions of about ``limit`` bytes, in the order of the listing."""
    parts, size = [], limit
    for file in files:
        weight = max(file[2], OPEN_BYTES)
        if size + weight > limit and (not parts or parts[-1].files):
            parts.append(Files([]))
            size = 0
        parts[-1].files.append(file)
        size += weight
    return parts


class CorpusReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, limit: int, skipped: tuple[str, ...] | None, types: dict[str, str], admitted: tuple[str, ...]):
        self.path, self.recursive, self.limit, self.skipped, self.types, self.admitted = path, recursive, limit, skipped, types, admitted

    def _typed(self, name: str) -> tuple[str, bool]:
        bare = re.sub(r"\.(gz|Z|bz2|xz|br)\Z", "", name)
        found = re.search(r".(\.[^.]+)\Z", bare)
        mime = self.types.get(found.group(1).lower(), "application/octet-stream") if found else "application/octet-stream"
        return mime, mime.startswith("text/") or mime in self.admitted

    def partitions(self) -> list[Files]:
        """Runs once, where the query is planned; only names and sizes are read."""
        fs, root = open_path(self.path)
        found = [(path, relative, size, *self._typed(path.rsplit("/", 1)[-1])) for path, relative, size in listed(fs, root.rstrip("/"), self.recursive, self.skipped)]
        return packed(found, self.limit) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_path(self.path)
        names = ["path", "relative", "length", "mime_type", "admitted", "content"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for path, relative, size, mime, admitted in partition.files:
            content = None
            if admitted and self.skipped is not None:
                with fs.open_input_stream(path) as file:
                    content = file.read()
            row = (path, relative, size, mime, admitted, content)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)


class CorpusSource(DataSource):
    """Options: ``path``, ``recursive`` (true), ``taskBytes``, ``everything`` (false): list all files, hidden
    ones too, and open none."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CorpusReader:
        from vouchspark.sources.files import PDF_MIME, SKIPPED_FOLDERS, TEXT_MIMES, _mime_table

        recursive = str(self.options.get("recursive", "true")).lower() == "true"
        skipped = None if str(self.options.get("everything", "false")).lower() == "true" else SKIPPED_FOLDERS
        return CorpusReader(self.options["path"], recursive, int(self.options.get("taskBytes", TASK_BYTES)), skipped, _mime_table(), (*TEXT_MIMES, PDF_MIME))


def read_corpus(spark: SparkSession, path: str, recursive: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Files below ``path``: path, relative, length, mime_type, admitted, content (NULL if the type is not
    admitted: such a file is listed, not opened)."""
    spark.dataSource.register(CorpusSource)
    return spark.read.format("corpus").option("recursive", str(recursive).lower()).option("taskBytes", task_bytes).load(path)


def all_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``relative`` and ``length`` of every file below ``path``; none is opened."""
    spark.dataSource.register(CorpusSource)
    return spark.read.format("corpus").option("everything", "true").load(path).select("path", "relative", "length")


def file_hashes(files: DataFrame, task_bytes: int = TASK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``path``, ``sha256``, ``length`` of files given by ``path`` and ``length``.

    Paths are dealt out by size, and a task holds one piece of one file at a time."""
    places = running_sums(files.select("path", F.greatest("length", F.lit(OPEN_BYTES)).alias("weight"), "length"), [F.col("path")], {"before": "weight"})
    dealt = places.withColumn("part", F.floor(F.col("before") / task_bytes)).select("path", "length", "part")
    many = max(1, (dealt.agg(F.max("part")).first()[0] or 0) + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests = []
            for path in frame["path"]:
                fs, local = open_path(path)
                digest = hashlib.sha256()
                with fs.open_input_stream(local) as file:
                    while piece := file.read(piece_bytes):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pd.DataFrame({"path": frame["path"], "sha256": digests, "length": frame["length"]})

    return dealt.repartition(many, "part").mapInPandas(run, "path string, sha256 string, length long")
