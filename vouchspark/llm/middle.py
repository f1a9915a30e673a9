"""Fill-in-the-middle transformation with a piece table.

A document is never cut or glued as text.  It is a list of descriptors (buffer, start, length) over
two immutable buffers: its own UTF-8 bytes and the sentinels.  Cutting splits a descriptor,
an arrangement permutes the list and puts descriptors of sentinels between, and the inverse
permutation over the written document gives the text back.  Hashes and lengths run over the
descriptors; bytes are joined only where the written text itself is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the transformation.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Hundredths of the documents that are transformed, and of these the ones with the suffix first.
PART, SUFFIX_FIRST, SEED = 90, 20, 1
#: Which part of the document (0 prefix, 1 middle, 2 suffix) stands at each place, and its sentinel.
ARRANGEMENTS = {"psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}
TEXT, MARK = 0, 1
RESULT = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, "
    "output string, output_sha256 string, restored_sha256 string"
)


@dataclass(frozen=True)
class Piece:
    """``length`` bytes of a buffer from ``start``."""

    buffer: int
    start: int
    length: int

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.buffer, self.start, at), Piece(self.buffer, self.start + at, self.length - at)


class PieceTable:
    """Descriptors over a document and the sentinels."""

    def __init__(self, document: bytes, pieces: list[Piece] | None = None):
        self.buffers = (memoryview(document), memoryview(SENTINELS))
        self.pieces = [Piece(TEXT, 0, len(document))] if pieces is None else pieces

    def cut(self, *places: int) -> None:
        """Split the descriptors at byte places of the table, ascending; empty pieces stay."""
        made, done, rest = [], 0, list(places)
        for piece in self.pieces:
            while rest and rest[0] <= done + piece.length:
                left, piece = piece.split(rest.pop(0) - done)
                made.append(left)
                done += left.length
            made.append(piece)
            done += piece.length
        self.pieces = made

    def arranged(self, form: str) -> PieceTable:
        """The three pieces in the order of ``form``, each behind its sentinel."""
        out: list[Piece] = []
        for part, mark in ARRANGEMENTS[form]:
            out += [Piece(MARK, SENTINELS.index(mark), len(mark)), self.pieces[part]]
        return PieceTable(self.buffers[TEXT], out)

    def restored(self, form: str) -> PieceTable:
        """Inverse of ``arranged`` over a written document: its sentinels are found, the pieces
        between them go back to their places and the sentinels' descriptors fall away."""
        text, order = self.buffers[TEXT].obj, ARRANGEMENTS[form]
        starts = []
        for _, mark in order:
            starts.append(text.index(mark, starts[-1] if starts else 0))
        self.cut(*(place for start, (_, mark) in zip(starts, order, strict=True) for place in (start, start + len(mark))))
        # cut() leaves an empty piece, then mark and part by turns.
        parts = {part: self.pieces[2 + 2 * at] for at, (part, _) in enumerate(order)}
        return PieceTable(text, [parts[part] for part in range(len(order))])

    def stream(self) -> Iterator[memoryview]:
        for piece in self.pieces:
            yield self.buffers[piece.buffer][piece.start : piece.start + piece.length]

    def written(self) -> bytes:
        return b"".join(self.stream())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()


def code_points(text: bytes) -> np.ndarray | None:
    """Byte places where code points start; None for ASCII, where they are the bytes."""
    if text.isascii():
        return None
    return np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)


def draws(doc_id: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that depend on seed and id alone."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in range(0, 16, 4))


@dataclass(frozen=True)
class Plan:
    """Form of a document and, unless plain, its two cuts in code points and in bytes."""

    n: int
    form: str
    cuts: tuple[int, int] | None = None
    places: tuple[int, int] | None = None


def plan(doc_id: int | None, text: bytes, part: int = PART, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> Plan:
    points = code_points(text)
    n = len(text) if points is None else len(points)
    if not n or doc_id is None or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Plan(n, "plain")
    first, second, chance, order = draws(doc_id, seed)
    if chance % 100 >= part:
        return Plan(n, "plain")
    cuts = tuple(sorted((first % (n + 1), second % (n + 1))))
    places = cuts if points is None else tuple(int(points[c]) if c < n else len(text) for c in cuts)
    return Plan(n, "spm" if order % 100 < suffix_first else "psm", cuts, places)


def restored_text(output: bytes, form: str) -> PieceTable:
    """Table of the original text from what was written and its form alone."""
    table = PieceTable(output)
    return table if form == "plain" else table.restored(form)


def transform(docs: DataFrame, *, part: int = PART, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, texts: bool = True, digests: bool = False) -> DataFrame:
    """Documents (``doc_id``, ``text``) with a piece moved to the end: one row per row with ``n``
    (code points), ``form`` (``plain``, ``psm``, ``spm``), ``prefix_chars``, ``middle_chars`` (NULL if
    plain), ``pieces`` (descriptors: buffer 0 is the UTF-8 text, buffer 1 ``SENTINELS``, places in
    bytes), ``output`` and the SHA-256 of what was written and of what it restores to.

    ``texts=False`` leaves ``output`` NULL, ``digests=False`` the hashes.  A NULL text counts as
    empty.  Empty texts, texts with a sentinel in them and rows with a NULL id (which has no draw)
    are plain.  Rows that repeat an id are cut by the same draws, each on its own text.  Further
    columns are not looked at, whatever their names.  Every row is made where it lies, without a
    shuffle; a task holds one batch of texts.
    """
    kinds = T.StructType.fromDDL(RESULT)
    places = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), places, pa.binary(), pa.string(), pa.string()]

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(key.as_py(), text.as_py() or b"") for key, text in zip(batch.column(0), batch.column(1), strict=True)]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], kind) for kind in types]
            columns[6] = columns[6].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, kinds.names)

    def _row(doc_id: int | None, text: bytes) -> tuple:
        own, table = plan(doc_id, text, part, suffix_first, seed), PieceTable(text)
        if own.cuts:
            table.cut(*own.places)
            table = table.arranged(own.form)
        output = table.written() if texts or digests else None
        told = (table.sha256(), restored_text(output, own.form).sha256()) if digests else (None, None)
        chars = (own.cuts[0], own.cuts[1] - own.cuts[0]) if own.cuts else (None, None)
        pieces = [{"buffer": p.buffer, "start": p.start, "length": p.length} for p in table.pieces]
        return (doc_id, own.n, own.form, *chars, pieces, output if texts else None, *told)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(make, kinds)


def restore(written: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` from the rows of ``transform`` (``doc_id``, ``form``, ``output``): exactly the
    texts that went in, NULL texts as empty ones.  A NULL ``output`` stays NULL."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if out is None else restored_text(out, form).written() for form, out in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return written.select("doc_id", "form", F.col("output").cast("binary").alias("output")).mapInArrow(make, "doc_id long, text string")
