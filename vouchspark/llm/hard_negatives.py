"""Hard negatives by Kronecker-packed integer products.

Components become integers.  Those of several candidates, biased so that none is negative, lie in
separate fields of one wide integer: ``X_j = sum_f (c_fj + b) 2^(w f)``.  One multiplication per
component of an anchor then serves all fields, ``sum_j (a_j + b') X_j``, and as a field is wide enough
for the largest possible sum, no field runs into the next one.  Unpacking a field and taking the
biases off gives the exact inner product.

The wide integer is the 53 bits of a double where two fields or one fit, so that BLAS multiplies
whole blocks and every partial sum is exact; for components beyond that it is a Python integer with
one field for every candidate of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.storage import stored
from vouchspark.operators.scaling import first_rows

SCALE = 256
EVERY, POSITIVES, NEGATIVES, LEAST = 100, 5, 5, 80
#: Bits that a double multiplies and adds exactly.
DOUBLE_BITS = 53
#: Rows with a component beyond this go to the wide integers.
NARROW = 1 << 20
#: Candidates of a block, and scores held at once.
BLOCK_ROWS, CELLS = 2048, 2_000_000
#: Anchors of a pass, in bytes of their components; more anchors take more passes.
ANCHOR_BYTES = 32 * 1024 * 1024
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def integers(vectors: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` of finite doubles: int64, or Python integers where a component is large."""
    if not vectors.size or np.abs(vectors).max() < 1 << 40:
        return np.floor(SCALE * vectors).astype(np.int64)
    whole = [SCALE * int(x) if abs(x) >= 1 << 52 else int(np.floor(SCALE * x)) for x in vectors.ravel()]
    return np.array(whole, dtype=object).reshape(vectors.shape)


@dataclass(frozen=True)
class Rows:
    """Ids, labels and integer vectors of one length, all narrow or all wide."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def part(self, at) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.vectors[at])


def usable(batch: pa.RecordBatch) -> Iterator[Rows]:
    """Rows with id, label and a vector of finite components, by length and kind."""
    ids, labels, lists = batch.column(0), batch.column(1), batch.column(2)
    there = pc.and_(pc.and_(ids.is_valid(), labels.is_valid()), lists.is_valid()).to_numpy(zero_copy_only=False)
    ids, labels = (x.cast(pa.int64()).fill_null(0).to_numpy() for x in (ids, labels))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[there]):
        at = np.flatnonzero(there & (lengths == dim))
        vectors = values[starts[at][:, None] + np.arange(dim)]
        fine = np.isfinite(vectors).all(axis=1)
        at, vectors = at[fine], vectors[fine]
        narrow = (np.abs(vectors) < NARROW / SCALE).all(axis=1)
        for kind in (narrow, ~narrow):
            if kind.any():
                yield Rows(ids[at[kind]], labels[at[kind]], integers(vectors[kind]))


def field_bits(dim: int, top_a: int, top_b: int) -> int:
    """Width of a field: room for ``dim`` products of biased components."""
    return max(1, int(dim * top_a * top_b).bit_length())


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, held within the limits of a long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    dim = a.shape[1]
    low_a, low_b = int(a.min()), int(b.min())
    width = field_bits(dim, int(a.max()) - low_a, int(b.max()) - low_b)
    top = dim * max(int(a.max()), -low_a) * max(int(b.max()), -low_b)  # the biases fit a long below, also where a side is constant
    if width <= DOUBLE_BITS and top < 1 << 60 and a.dtype != object and b.dtype != object:
        # sum (a - la)(b - lb) = sum a b - lb sum a - la sum b + dim la lb
        left = low_b * a.sum(axis=1)[:, None] + low_a * b.sum(axis=1)[None, :] - dim * low_a * low_b
        return _double_products(a - low_a, b - low_b, width) + left
    a, b = a.astype(object), b.astype(object)
    left = low_b * a.sum(axis=1)[:, None] + low_a * b.sum(axis=1)[None, :] - dim * low_a * low_b
    exact = _wide_products(a - low_a, b - low_b, width) + left
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


def _double_products(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Products of non-negative vectors, as many fields to a double as its bits hold."""
    fields = DOUBLE_BITS // width
    many = -(-len(b) // fields)
    packed = np.zeros((many, b.shape[1]))
    for f in range(fields):
        own = b[f * many : (f + 1) * many]
        packed[: len(own)] += np.ldexp(own.astype(np.float64), width * f)
    wide = (a.astype(np.float64) @ packed.T).astype(np.int64)
    mask = (1 << width) - 1
    return np.concatenate([(wide >> (width * f)) & mask for f in range(fields)], axis=1)[:, : len(b)]


def _wide_products(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The same with one Python integer per component that holds a field for every row of ``b``."""
    size = -(-max(width, int(b.max()).bit_length()) // 8)  # a field holds its component too, where all of ``a`` is zero
    packed = [int.from_bytes(b"".join(int(c).to_bytes(size, "little") for c in column), "little") for column in b.T]
    out = np.empty((len(a), len(b)), dtype=object)
    for i, anchor in enumerate(a):
        total = sum(int(x) * wide for x, wide in zip(anchor, packed, strict=True)).to_bytes(size * len(b), "little")
        out[i] = [int.from_bytes(total[at : at + size], "little") for at in range(0, len(total), size)]
    return out


class Search:
    """The best ``k`` rows of every slot, fed with blocks of candidates.

    A slot is an anchor with a range of scores; ``same`` says whether it asks for rows of the
    anchor's label or of all others.  Higher scores come first, then smaller ids; a row that is
    repeated counts once, and rows with the anchor's id are never found.
    """

    def __init__(self, anchors: Rows, slots: np.ndarray, lowest: np.ndarray, highest: np.ndarray, same: bool, k: int):
        self.anchors, self.slots, self.highest, self.same, self.k = anchors, slots, highest, same, k
        self.floor = lowest.copy()
        self.found = np.zeros(len(slots), dtype=np.int64)
        self.score, self.ids = (np.zeros((len(slots), k), dtype=np.int64) for _ in range(2))

    def feed(self, rows: Rows) -> None:
        for at in range(0, len(rows.ids), BLOCK_ROWS):
            self._block(rows.part(slice(at, at + BLOCK_ROWS)))

    def _block(self, rows: Rows) -> None:
        step = max(1, CELLS // max(1, len(rows.ids)))
        for lo in range(0, len(self.slots), step):
            own = self.slots[lo : lo + step]
            first, last = int(own[0]), int(own[-1]) + 1
            anchors = self.anchors.part(slice(first, last))
            product = scores(anchors.vectors, rows.vectors)
            fits = (anchors.labels[:, None] == rows.labels[None, :]) == self.same
            fits &= anchors.ids[:, None] != rows.ids[None, :]
            if len(own) != last - first:
                product, fits = product[own - first], fits[own - first]
            fits &= (product >= self.floor[lo : lo + step, None]) & (product <= self.highest[lo : lo + step, None])
            slot, column = np.nonzero(fits)
            if len(slot):
                self._merge(slot + lo, product[slot, column], rows.ids[column])

    def _merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slot)
        held = np.arange(self.k)[None, :] < self.found[touched][:, None]
        slot = np.concatenate([np.repeat(touched, self.found[touched]), slot])
        score = np.concatenate([self.score[touched][held], score])
        ids = np.concatenate([self.ids[touched][held], ids])
        order = np.lexsort((ids, ~score, slot))  # ~x falls as x rises, for every long
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.ones(len(slot), dtype=bool)
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[new], score[new], ids[new]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        slot, score, ids, place = slot[keep], score[keep], ids[keep], place[keep]
        self.score[slot, place], self.ids[slot, place] = score, ids
        self.found[touched] = np.bincount(np.searchsorted(touched, slot), minlength=len(touched))
        full = touched[self.found[touched] == self.k]
        self.floor[full] = self.score[full, self.k - 1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, score and id of everything found."""
        held = np.arange(self.k)[None, :] < self.found[:, None]
        return np.repeat(np.arange(len(self.slots)), self.found), self.score[held], self.ids[held]


def _scan(vectors: DataFrame, sent, names: tuple[str, str, str], same: bool, k: int) -> DataFrame:
    """One pass over all vectors: the best rows that each task met, for every slot of ``sent``: a
    list of (anchors, anchor numbers, slots, lowest, highest) by length and kind of vectors."""
    kinds = ", ".join(f"{c} long" for c in ("a", "anchor_id", *names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [(numbers, Search(anchors, slots, low, high, same, k)) for anchors, numbers, slots, low, high in sent.value]
        for batch in batches:
            for rows in usable(batch):
                for _, search in searches:
                    if search.anchors.vectors.shape[1] == rows.vectors.shape[1]:
                        search.feed(rows)
        for numbers, search in searches:
            slot, score, ids = search.rows()
            at = search.slots[slot]
            columns = [numbers[at], search.anchors.ids[at], search.highest[slot], score, ids]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "anchor_id", *names])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, kinds)


def _passes(anchors: DataFrame, limit: int) -> list[DataFrame]:
    """Anchors in groups whose components take about ``limit`` bytes at most; one job measures."""
    size = anchors.agg(F.sum(F.size("embedding") * 8 + 64).alias("b")).first()["b"] or 0
    many = max(1, -(-size // limit))
    if many == 1:
        return [anchors] if size else []
    group = F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(many))
    return [anchors.filter(group == g) for g in range(many)]


def _anchor_rows(anchors: DataFrame) -> list[tuple[Rows, np.ndarray]]:
    """Anchors of a pass with their numbers, in order of their ids, by length and kind."""
    found, at = [], 0
    table = anchors.select("vec_id", "label", "embedding").orderBy("vec_id", "label", "embedding").toArrow().combine_chunks()
    for batch in table.to_batches():
        for rows in usable(batch):
            found.append((rows, np.arange(at, at + len(rows.ids))))
            at += len(rows.ids)
    return found


def mine(
    vectors: DataFrame, *, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, anchor_bytes: int = ANCHOR_BYTES
) -> DataFrame:
    """Hard negatives of ``vectors`` (``vec_id``, ``label``, ``embedding``): ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows whose id is divisible by ``every``.  All rows are scored by their integer
    inner product with an anchor, higher first, then smaller id.  Its positives are the first rows of
    its label; a positive's negatives are the first rows of other labels with a score of ``least``
    hundredths of the positive's up to the positive's.

    Rows with a NULL id, label or vector, or with a NULL or non-finite component take no part.
    Vectors of different lengths do not meet; an empty one has the score 0 with another.  Repeated
    rows count once, rows with the anchor's own id never; an id with several vectors is an anchor
    with each.  Scores beyond a long are held at its limits.  An empty table, and a table without
    anchors, give no row.  Further columns are not looked at, whatever their names.

    Two scans of all vectors for each pass of at most ``anchor_bytes`` of anchors; a scan keeps the
    best rows per anchor in each task, so that only these are shuffled.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    mine_them = vectors.filter((F.col("vec_id") % every == 0) & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    anchors = stored(mine_them.dropDuplicates(["vec_id", "label", "embedding"]), "anchors")
    out = None
    for group in _passes(anchors, anchor_bytes):
        asked = _anchor_rows(group)
        if not asked:
            continue
        whole = [(rows, numbers, np.arange(len(numbers)), np.full(len(numbers), LOWEST), np.full(len(numbers), HIGHEST)) for rows, numbers in asked]
        met = _scan(vectors, spark.sparkContext.broadcast(whole), ("_top", "positive_score", "positive_id"), True, positives).drop("_top").distinct()
        met = stored(first_rows(met, ["a"], [F.col("positive_score").desc(), F.col("positive_id")], positives, "_at").drop("_at"), "positives")
        ranges = met.select("a", "positive_score").distinct().orderBy("a", "positive_score").toArrow()
        owner, score = (ranges.column(c).to_numpy() for c in ("a", "positive_score"))
        slots = []
        for rows, numbers in asked:
            own = (owner >= numbers[0]) & (owner <= numbers[-1])
            if own.any():
                low = np.array([min(HIGHEST, -(-least * int(s) // 100)) for s in score[own]], dtype=np.int64)
                slots.append((rows, numbers, owner[own] - numbers[0], low, score[own]))
        hard = _scan(vectors, spark.sparkContext.broadcast(slots), ("positive_score", "negative_score", "negative_id"), False, negatives).drop("anchor_id").distinct()
        hard = first_rows(hard, ["a", "positive_score"], [F.col("negative_score").desc(), F.col("negative_id")], negatives, "rank")
        found = met.join(hard, ["a", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
