"""Best-fit packing of token pieces by the sum-of-squares rule.

A sequence holds at most ``capacity`` tokens.  Pieces come longest first.  For each one the rule
looks at how many open bins there are per residual gap and puts it where the sum of the squared
counts becomes smallest: into a bin of some gap, or into a new one.  Equal sums go to the
tightest bin, and an existing bin before a new one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.bpe import encoder
from vouchspark.llm.storage import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that meet in one task.  A group leaves about one sequence partly empty.
GROUP_PIECES = 4096


def sum_of_squares_bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length.  ``counts[g]`` is the number of open bins with gap
    ``g``; full bins are closed and count no more."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    bins_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for at in np.argsort(-lengths, kind="stable"):
        n = int(lengths[at])
        # Moving a bin from gap g to g - n changes the sum by 2 (counts[g - n] - counts[g]) + 2;
        # a bin that becomes full leaves the sum, so only its old gap changes.
        change = 2 * (counts[: capacity + 1 - n] - counts[n:]) + 2
        change[0] = 1 - 2 * counts[n]
        change[counts[n:] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change)) if n <= capacity else 0
        new = 2 * counts[capacity - n] + 1 if n < capacity else 0
        if change[best] <= new:
            gap = best + n
            number = bins_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = capacity, made
            made += 1
        bins[at], offsets[at] = number, capacity - gap
        if gap > n:
            bins_by_gap[gap - n].append(number)
            counts[gap - n] += 1
    return bins, offsets


def token_pieces(
    docs: DataFrame, tokenizer_path: str, drops_blanks: bool, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document's ids with ``end_id`` behind them.

    Documents up to ``capacity`` tokens are one piece, longer ones are cut every ``capacity``
    tokens.  A NULL or empty text has the end id alone; a NULL id stays NULL.  No shuffle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(tokenizer_path, drops_blanks), np.uint32(end_id).tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, key = enc.encode(text.as_py()) + end, key.as_py()
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    Only keys and lengths move.  Pieces are dealt by a hash into groups of about
    ``group_pieces``, so no group grows with the input, and each group is packed on its own;
    sequence numbers are the group number times 2^32 plus the bin.  Equal rows may swap places.
    ``pieces`` is read twice (count, then packing): store it first.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    keyed = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares_bins(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=rows.pop("_group") * (1 << 32) + bins, offset=offsets)

    return keyed.groupBy("_group").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, drops_blanks: bool = True, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Tokenise whole documents and pack all of them.  Runs two jobs (store, count)."""
    return pack(stored(token_pieces(docs, tokenizer_path, drops_blanks, end_id, capacity), "pieces"), capacity)
