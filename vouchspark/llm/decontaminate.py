"""Benchmark decontamination by suffix arrays of the training documents.

Every task cuts its documents into shards.  A shard is one array of word codes in which documents
are kept apart, and a suffix array over it: the places of the shard in the order of the words that
follow.  Each suffix of a benchmark item is looked up by binary search; its first ten words (or
the whole item, where that has fewer) are a window, and the range of the suffix array that starts
with a window holds all its occurrences.  Occurrences that follow each other in both texts chain to
the longest verbatim matches.

Codes come from the words of the benchmark alone.  A word that no item has is 0 and can be in no
match; places from which no window can start, since a 0 follows too soon, are left out of the
suffix array.  Codes are exact, there are no hashes to collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vouchspark.llm.storage import stored
from vouchspark.operators.scaling import measured_bytes

WINDOW = 10
#: Words of a shard, unless one document has more.
SHARD_WORDS = 1 << 20
#: Text of the items that are looked up at once; more items are taken in blocks.
BLOCK_BYTES = 16 * 1024 * 1024
#: Bytes that are split into words at a time.
PIECE_BYTES = 8 * 1024 * 1024
#: Ends a document inside a shard; no word is like it.
BREAK = b"\x01"
#: Letters that words are made of stay, A-Z become a-z, everything else is a blank.
_LETTERS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of an UTF-8 text, A-Z lower-cased."""
    return text.translate(_LETTERS).split() if text else []


@dataclass(frozen=True)
class Items:
    """A block of items: codes of their words, and the distinct windows by length.

    ``windows`` has for each length the windows as rows of codes and, per window, where its list of
    (item, place) starts in ``item`` and ``place``; items are numbers into ``names``."""

    codes: dict[bytes, int]
    names: np.ndarray
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @property
    def shortest(self) -> int:
        return min((w.shape[1] for w, *_ in self.windows), default=0)


def prepare(rows: list[tuple[object, bytes | None]], window: int = WINDOW) -> Items:
    """Windows of items (id, text).  An item with a NULL id marks words but is not named."""
    codes: dict[bytes, int] = {}
    made: dict[int, list[tuple[tuple[int, ...], int, int]]] = {}
    for item, (_, text) in enumerate(rows):
        own = [codes.setdefault(w, len(codes) + 1) for w in words(text)]
        n = min(window, len(own))
        for at in range(len(own) - n + 1 if n else 0):
            made.setdefault(n, []).append((tuple(own[at : at + n]), item, at))
    windows = []
    for _, found in sorted(made.items()):
        found.sort()
        rows_of = np.array([w for w, _, _ in found], dtype=np.int32)
        new = np.ones(len(found), dtype=bool)
        new[1:] = (rows_of[1:] != rows_of[:-1]).any(axis=1)
        starts = np.append(np.flatnonzero(new), len(found))
        windows.append((rows_of[new], starts, np.array([i for _, i, _ in found]), np.array([p for _, _, p in found])))
    return Items(codes, np.array([name for name, _ in rows], dtype=object), windows)


def suffix_array(codes: np.ndarray, least: int, depth: int) -> np.ndarray:
    """Places of ``codes`` in the order of the ``depth`` codes from there on, by doubling: the rank by
    ``2 h`` codes is that of the pair of ranks by ``h`` at the place and ``h`` further.

    Only places followed by at least ``least`` codes other than 0 are in it.  What comes behind a 0
    does not count, since no window has one."""
    ends = np.append(np.flatnonzero(codes == 0), len(codes))
    begins = np.append(0, ends[:-1] + 1)
    long_enough = ends - begins >= least
    begins, lengths = begins[long_enough], (ends - begins)[long_enough]
    places = _spread(begins, lengths)
    rank = np.zeros(len(codes) + depth, dtype=np.int64)
    rank[places] = codes[places]
    h = 1
    while h < depth and len(places):
        step = min(h, depth - h)
        key = rank[places] * (int(rank.max()) + 1) + rank[places + step]
        rank[places] = np.unique(key, return_inverse=True)[1] + 1
        h += step
    places = places[np.repeat(begins + lengths, lengths) - places >= least]
    return places[np.argsort(rank[places], kind="stable")]


def _compared(codes: np.ndarray, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """-1, 0, 1: the codes from each place come before, start with, come after its window."""
    out = np.zeros(len(at), dtype=np.int8)
    for k in range(windows.shape[1]):
        open_ = np.flatnonzero(out == 0)
        if not len(open_):
            break
        out[open_] = np.sign(codes[at[open_] + k].astype(np.int64) - windows[open_, k])
    return out


def ranges(codes: np.ndarray, suffixes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffix array that starts with each window, by binary search for all at once."""
    edges = []
    for after in (0, 1):
        lo, hi = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(suffixes), dtype=np.int64)
        while (going := np.flatnonzero(lo < hi)).size:
            mid = (lo[going] + hi[going]) // 2
            right = _compared(codes, suffixes[mid], windows[going]) < after
            lo[going[right]], hi[going[~right]] = mid[right] + 1, mid[~right]
        edges.append(lo)
    return edges[0], edges[1]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers ``start .. start + count - 1`` of all ranges in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def occurrences(codes: np.ndarray, items: Items, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each length of windows: places in the shard, number of the window there, length."""
    if not items.windows:
        return
    padded = np.concatenate([codes, np.zeros(window, dtype=codes.dtype)])
    suffixes = suffix_array(codes, items.shortest, window)
    for rows, *_ in items.windows:
        lo, hi = ranges(padded, suffixes, rows)
        yield suffixes[_spread(lo, hi - lo)], np.repeat(np.arange(len(rows)), hi - lo), rows.shape[1]


class Shard:
    """Documents of a task that are searched together: one text in which ``BREAK`` ends each."""

    def __init__(self, texts: list[bytes | None]):
        self.text = b"".join([(text or b"").translate(_LETTERS) + b" " + BREAK + b" " for text in texts])
        at = np.flatnonzero(self._codes({BREAK: -1}) if len(texts) else np.empty(0))
        self.starts, self.n = np.append(0, at[:-1] + 1)[: len(at)], np.diff(np.append(-1, at)) - 1

    def _codes(self, codes: dict[bytes, int]) -> np.ndarray:
        """Codes of all words, piece by piece, so that the words of a long text are not all held."""
        found, at = [], 0
        while at < len(self.text):
            end = self.text.find(b" ", at + PIECE_BYTES) if at + PIECE_BYTES < len(self.text) else len(self.text)
            own = self.text[at : end if end >= 0 else len(self.text)].split()
            found.append(np.fromiter(map(codes.get, own, repeat(0)), dtype=np.int32, count=len(own)))
            at += max(1, (end if end >= 0 else len(self.text)) - at)
        return np.concatenate(found) if found else np.empty(0, dtype=np.int32)

    def codes(self, items: Items) -> np.ndarray:
        """Codes of all documents, a 0 behind each."""
        return self._codes(items.codes)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def _named(doc: np.ndarray, window: np.ndarray, starts: np.ndarray, item: np.ndarray) -> set[tuple[int, int]]:
    """Distinct (document, item) of occurrences.  Windows with the same items count as one, so that
    passages that very many items share are not taken once for every window of theirs."""
    lists = {k: item[starts[k] : starts[k + 1]] for k in np.unique(window).tolist()}
    kinds: dict[bytes, int] = {}
    kind = {k: kinds.setdefault(np.unique(own).tobytes(), len(kinds)) for k, own in lists.items()}
    of_kind = [np.frombuffer(own, dtype=item.dtype) for own in kinds]
    told = {(d, kind[w]) for d, w in zip(doc.tolist(), window.tolist(), strict=True)}
    return {(d, i) for d, k in told for i in of_kind[k].tolist()}


def _blocks(benchmark: DataFrame, limit: int) -> list[list[tuple[object, bytes | None]]]:
    """Items (id, text) in blocks of about ``limit`` bytes; each is broadcast on its own."""
    known = benchmark.select(F.col("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    known = stored(known, "items")
    many = max(1, -(-measured_bytes(known) // limit))
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(many))
    blocks = [[(r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in known.filter(group == g).collect()] for g in range(many)]
    return [sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or b"")) for rows in blocks if rows]


class _Blocks:
    """The blocks inside a task, one after the other; only one of several is held at a time."""

    def __init__(self, sent: list):
        self.sent = sent

    def __iter__(self) -> Iterator[Items]:
        for block in self.sent:
            yield block.value
            if len(self.sent) > 1:
                block.__dict__.pop("_value", None)  # read from the executor's store again next time


def _shards(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    """Rows of a batch with the shard of their texts, about ``limit`` words each."""
    for batch in batches:
        # Bytes stand for words, about six to one.
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)) // (6 * limit)
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                part = batch.slice(lo, hi - lo)
                yield part, Shard([t.as_py() for t in part.column(column)])


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int):
    """Broadcast blocks of prepared items."""
    context = docs.sparkSession.sparkContext
    return _Blocks([context.broadcast(prepare(rows, window)) for rows in _blocks(benchmark, block_bytes)])


def measure(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` (``text`` among them) with ``n_words``, ``n_hit`` (words inside
    an occurrence of a window of ``benchmark``), ``items`` (the ids of the items with occurring
    windows, sorted as strings) and ``contaminated`` (``n_hit > 0``).  Columns of these names are replaced.

    Items are ``benchmark`` (``item_id``, ``text``).  A window is ``window`` consecutive words of an item; an
    item of fewer words is one window, an item without words or with a NULL text none.  Items that
    repeat an id are one item; one with a NULL id marks words but is not named.  A document with a
    NULL or empty text has no words.  An empty benchmark leaves all documents clean.

    Documents stay where they lie, a task holds one batch of them; nothing is shuffled.  A window
    of any number of documents costs its occurrences.  Items are broadcast in blocks of a checked
    size, and a task looks at one block at a time.
    """
    blocks = _searched(docs, benchmark, window, block_bytes)
    added = ["n_words", "n_hit", "items", "contaminated"]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL("n_words long, n_hit long, items array<string>, contaminated boolean").fields])
    plain = kept.withColumn("_text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, shard in _shards(batches, "_text", shard_words):
            inside = np.zeros(int((shard.n + 1).sum()) + 1, dtype=np.int64)
            named: list[set[str]] = [set() for _ in shard.n]
            for items in blocks:
                for (place, own, length), (_, starts, item, _) in zip(occurrences(shard.codes(items), items, window), items.windows, strict=False):
                    inside += np.bincount(place, minlength=len(inside)) - np.bincount(place + length, minlength=len(inside))
                    for doc, at in _named(shard.document(place), own, starts, item):
                        if items.names[at] is not None:
                            named[doc].add(str(items.names[at]))
            hit = np.add.reduceat(np.cumsum(inside) > 0, shard.starts) if len(shard.n) else shard.n
            columns = [*rows.columns[:-1], pa.array(shard.n), pa.array(hit.astype(np.int64)), pa.array([sorted(x) for x in named], pa.list_(pa.string())), pa.array(hit > 0)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns stay as they are."""
    marked = measure(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"), benchmark, **options)
    return marked.filter(~F.col("contaminated")).select("_row.*")


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Longest verbatim matches: ``doc_id``, ``item_id``, ``doc_start`` and ``item_start`` (words before the match,
    from 0), ``n_words``.  No match can be made longer at either end.  Rules are those of ``measure``;
    rows with a NULL document or item id keep it, repeated documents are told once per row.

    A task gives the matches of its shards; a match lies in one document, so nothing is shuffled.
    """
    blocks = _searched(docs, benchmark, window, block_bytes)
    kind = benchmark.schema["item_id"].dataType
    told = to_arrow_type(kind)
    schema = T.StructType.fromDDL("doc_id long, doc_start long, item_start long, n_words long").add("item_id", kind)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, shard in _shards(batches, "text", shard_words):
            for items in blocks:
                for (place, own, length), (_, starts, item, at) in zip(occurrences(shard.codes(items), items, window), items.windows, strict=False):
                    many = starts[own + 1] - starts[own]
                    listed = _spread(starts[own], many)
                    place, item_of, item_at = np.repeat(place, many), item[listed], at[listed]
                    order = np.lexsort((place, place - item_at, item_of))
                    place, item_of, item_at = place[order], item_of[order], item_at[order]
                    new = np.ones(len(place), dtype=bool)
                    new[1:] = (place[1:] != place[:-1] + 1) | (item_at[1:] != item_at[:-1] + 1) | (item_of[1:] != item_of[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(place)) - 1 if len(first) else first
                    doc = shard.document(place[first])
                    columns = [
                        rows.column("doc_id").take(pa.array(doc)), pa.array(place[first] - shard.starts[doc]), pa.array(item_at[first].astype(np.int64)),
                        pa.array(place[last] - place[first] + length), pa.array(items.names[item_of[first]].tolist(), told),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(run, schema).select("doc_id", "item_id", "doc_start", "item_start", "n_words")
