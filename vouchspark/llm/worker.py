"""What Python workers share: a cache that outlives a task, and word splitting on bytes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import xxhash
from pyspark.sql import SparkSession


def kept(name: str, make: Callable[[], Any]) -> Any:
    """Object that a worker process keeps until another one is asked for.  Functions travel by
    value, so a module global would be built anew for every task; worker processes are reused, by
    later stages too, so what a stage kept goes when the next one keeps something of its own."""
    holder = sys.modules.setdefault("_vouchspark_worker", types.ModuleType("_vouchspark_worker"))
    held = holder.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send at most ``rows`` rows at a time to Python workers and back: with wide
    rows a batch is held by the executor and by the worker, once per core."""
    before = spark.conf.get(BATCH_ROWS, None)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if before and int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_ROWS) if before is None else spark.conf.set(BATCH_ROWS, before)


class Memo(dict):
    """Bounded memo: computes a missing value.  At ``limit`` entries the memo becomes the older
    half; what is asked for again moves over, the rest goes at the next turn."""

    def __init__(self, compute: Callable[[Any], Any], limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


#: A miss costs one hash, an entry some 200 bytes in every worker process.
WORD_LIMIT = 100_000


def _word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def word_hashes(text: bytes | None) -> np.ndarray:
    """Signed 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of an UTF-8 text, A-Z lower-cased.
    ``bytes.lower`` touches A-Z alone and ``bytes.split`` cuts at exactly these six blanks."""
    words = text.lower().split() if text else []
    memo = kept("word_hashes", lambda: Memo(_word_hash, WORD_LIMIT))
    return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
