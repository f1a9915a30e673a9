"""Token ids in seekable files: one zstandard frame per document and a trailing seek table.

A file follows the public seekable zstandard layout:

    frame of document 0 | frame of document 1 | ... | skippable frame: document ids | seek table

Every frame holds one document's ids as little-endian unsigned 32-bit integers and can be
decompressed alone.  The seek table is itself a skippable frame at the end of the file: the
compressed size, the size and the low 32 bits of the XXH64 of every frame, then the number of
frames.  Any zstandard tool can decompress the file as a whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouchspark.llm.bpe import encoder
from vouchspark.llm.storage import shared_folder

# Fixed values of the seekable zstandard format.
SEEK_TABLE_MAGIC, SEEK_END_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: One of the sixteen magic numbers that the format leaves to applications.
ID_TABLE_MAGIC = 0x184D2A50
NO_ID = -(1 << 63)
LEVEL = 1
MANIFEST = "file string, n_docs long, n_tokens long, n_bytes long"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    return pafs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Appends documents to an open stream; ``close`` adds the two tables."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.squeeze = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.ids: list[int] = []
        self.entries: list[tuple[int, int, int]] = []
        self.tokens = self.bytes = 0

    def _frame(self, frame: bytes, size: int, check: int) -> None:
        self.out.write(frame)
        self.entries.append((len(frame), size, check))
        self.bytes += len(frame)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(self.squeeze.compress(ids), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.tokens += len(ids) // 4

    def close(self) -> None:
        table = self.squeeze.compress(np.array(self.ids, dtype="<i8").tobytes())
        self._frame(struct.pack("<II", ID_TABLE_MAGIC, len(table)) + table, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        seek = np.array(self.entries, dtype="<u4").tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_END_MAGIC)
        self.out.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(seek)) + seek)
        self.bytes += 8 + len(seek)
        self.out.close()


class TokenFile:
    """Reads single documents of a file; only the tables and the asked frames are read."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file, self.unpack = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_END_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        self.table = np.frombuffer(self.file.read_at(12 * frames, size - 9 - 12 * frames), dtype="<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        head = self.file.read_at(int(self.table[-1, 0]), int(self.at[-2]))
        self.doc_ids = np.frombuffer(self.unpack.decompress(head[8:]), dtype="<i8")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def lengths(self) -> np.ndarray:
        """Number of ids of every document, from the seek table alone."""
        return self.table[:-1, 1].astype(np.int64) // 4

    def document(self, k: int) -> bytes:
        """Ids of the ``k``-th document; a frame that does not match its checksum is an error."""
        size, raw, check = (int(x) for x in self.table[k])
        ids = self.unpack.decompress(self.file.read_at(size, int(self.at[k])), max_output_size=raw) if raw else b""
        if len(ids) != raw or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return ids

    def find(self, doc_id: int) -> list[int]:
        """Places of a document id; files are in ascending order of ids."""
        lo, hi = np.searchsorted(self.doc_ids, [doc_id, doc_id], side="left"), np.searchsorted(self.doc_ids, doc_id, side="right")
        return list(range(int(lo[0]), int(hi)))

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, drops_blanks: bool = False, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents in ascending order of their ids; returns the stored manifest.

    Rows are range-partitioned by id (then by text, so that repeated ids have one order) and
    every task writes one file of its own, under a name of its attempt that is moved to the
    final name at the end: a task that runs again writes the same file.  A NULL text has the end
    id alone, NULL ids come first.  The manifest has one row per file.  Runs one job.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        enc, end, context = encoder(tokenizer_path, drops_blanks), np.uint32(end_id).tobytes(), TaskContext.get()
        name = f"part-{context.partitionId():06d}.ztok"
        writer = attempt = None
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    attempt = f"{root}/{name}.{context.taskAttemptId()}"
                    writer = TokenFileWriter(fs.open_output_stream(attempt))
                writer.add(key.as_py(), enc.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            fs.move(attempt, f"{root}/{name}")
            row = ([name], [len(writer.ids)], [writer.tokens], [writer.bytes])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["file", "n_docs", "n_tokens", "n_bytes"])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per stored document: ``doc_id``, ``start`` (ids before it in all files),
    ``n_tokens``, ``ids_crc32``.  The starts of files come from the manifest, which has one row
    per file; the frames are read in tasks, a file in each.  Runs one job (number of files)."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("_base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("file", "_base")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        for frame in frames:
            for name, base in zip(frame["file"], frame["_base"], strict=True):
                file = TokenFile(fs, f"{root}/{name}")
                n = file.lengths()
                starts = base + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
                crcs = np.fromiter((zlib.crc32(file.document(k)) for k in range(len(n))), dtype=np.int64, count=len(n))
                ids = pd.array(file.doc_ids.copy(), dtype="Int64")
                ids[file.doc_ids == NO_ID] = pd.NA
                file.close()
                yield pd.DataFrame({"doc_id": ids, "start": starts, "n_tokens": n, "ids_crc32": crcs})

    many = max(1, manifest.count())
    return files.repartition(many, "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """Ids of the asked documents only: ``doc_id``, ``ids``.  Every file gets the whole set of
    wanted ids, which must be small; frames of other documents are not decompressed."""
    keys = sorted(r[0] for r in wanted.select(F.col(wanted.columns[0]).cast("long")).distinct().collect() if r[0] is not None)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_folder(folder)
        for frame in frames:
            for name in frame["file"]:
                file = TokenFile(fs, f"{root}/{name}")
                rows = [(key, np.frombuffer(file.document(k), dtype="<u4").astype(np.int64)) for key in keys for k in file.find(key)]
                file.close()
                yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    return manifest.select("file").mapInPandas(read, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write all documents to a new folder of token files and read every one back."""
    spark: SparkSession = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer_path), folder)
