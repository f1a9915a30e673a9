"""Near duplicates among labelled vectors by int8 tile products with rigorous error bounds.

A unit vector ``u`` is stored as ``scale * q + e`` with ``q`` in int8.  For two of them
``u.v - (scale_u q_u).(scale_v q_v) = u.e_v + e_u.(scale_v q_v)``, so the exact cosine is at
most the product of the quantised vectors plus ``|e_v| + |e_u| (1 + |e_v|)``.  Tiles of int8
blocks are multiplied as matrices; only pairs whose bound reaches the threshold are computed
again from the full vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.graph import components
from vouchspark.llm.samples import sample_keys
from vouchspark.llm.storage import stored
from vouchspark.operators.scaling import all_salts, row_hash_salt

THRESHOLD = 0.93
#: Vectors of a block; a tile multiplies two blocks.
BLOCK_ROWS = 1024
#: Bound of the sample that the direction of the block order is fitted on.
SAMPLE_ROWS, SEED = 2000, 5
#: Room for rounding in double precision.
SLACK = 1e-9
PREPARED = "vec_id long, label long, dim int, class binary, q binary, scale double, error double, place double, vector binary"
BLOCKS = "label long, dim int, block long, lo double, hi double, n int, ids binary, q binary, scale binary, error binary"


def usable_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors in double precision, per vector length: rows with an id, a label
    and a vector that is not zero and has finite components only."""
    ids, labels, lists = batch.column(0), batch.column(1), batch.column(2)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    there = pc.and_(ids.is_valid(), labels.is_valid()).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == dim) & there)
        vectors = values[starts[rows][:, None] + np.arange(dim)] + 0.0  # no negative zero
        fine = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        if fine.any():
            yield rows[fine], vectors[fine]


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that squares stay in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale, and the length of what they leave out, rounded up."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    left = unit - scale[:, None] * q
    return q, scale, np.sqrt((left * left).sum(axis=1)) * (1 + SLACK) + SLACK


def upper_bounds(qa, sa, ea, qb, sb, eb) -> np.ndarray:
    """Largest possible cosines of two blocks.  Products of int8 sum exactly in single precision
    up to 1040 components, in double precision beyond."""
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    dots = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    return dots * (sa[:, None] * sb[None, :]) + (eb[None, :] + ea[:, None] * (1 + eb[None, :])) + SLACK


def main_direction(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[int, np.ndarray]:
    """Direction of largest spread of a bounded sample, and its length.  It only orders blocks:
    any direction gives the same links."""
    keys = sample_keys(vectors.filter("vec_id is not null and label is not null").select("vec_id"), rows, SEED)
    sample = vectors.join(F.broadcast(keys), "vec_id", "left_semi").select("vec_id", "label", "embedding").limit(2 * rows).toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for batch in sample.to_batches():
        for _, v in usable_rows(batch):
            found.setdefault(v.shape[1], []).append(units(v))
    if not found:
        return 0, np.zeros(0)
    dim, parts = max(found.items(), key=lambda x: sum(map(len, x[1])))
    unit = np.concatenate(parts)
    return dim, np.linalg.svd(unit - unit.mean(axis=0), full_matrices=False)[2][0]


def prepare(vectors: DataFrame) -> DataFrame:
    """Usable vectors, quantised, with a class that equal vectors of a label share."""
    dim, axis = main_direction(vectors)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PREPARED.split(", ")]
        for batch in batches:
            for rows, v in usable_rows(batch):
                u = units(v)
                q, scale, error = quantised(u)
                take = pa.array(rows)
                labels = batch.column(1).take(take).cast(pa.int64())
                keys = [xxhash.xxh3_128_digest(x.tobytes() + y.to_bytes(8, "little", signed=True)) for x, y in zip(v, labels.to_pylist(), strict=True)]
                place = u @ axis if v.shape[1] == dim else np.zeros(len(v))
                columns = [batch.column(0).take(take).cast(pa.int64()), labels, pa.array(np.full(len(v), v.shape[1], dtype=np.int32)), pa.array(keys, pa.binary()),
                           pa.array([x.tobytes() for x in q], pa.binary()), pa.array(scale), pa.array(error), pa.array(place), pa.array([x.tobytes() for x in v], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.select("vec_id", "label", "embedding").mapInArrow(make, PREPARED)


def blocks(classes: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one label, neighbours in the block order.

    Rows are range-partitioned by label and place, so a label that holds a third of all rows is
    spread over tasks; each task packs what it has into blocks."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, rest = TaskContext.get().partitionId(), 0, None
        for frame in [*frames, None]:
            if frame is not None:
                rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if rest is None or (frame is not None and len(rest) < rows):
                continue
            packed, kept = [], None
            for (label, dim), own in rest.groupby(["label", "dim"], sort=False):
                for at in range(0, len(own), rows):
                    x = own.iloc[at : at + rows]
                    kept = x if frame is not None and x.index[-1] == rest.index[-1] and len(x) < rows else None
                    if kept is None:
                        packed.append((label, dim, (part << 32) + made, x["place"].min(), x["place"].max(), len(x), x["first"].to_numpy(dtype=np.int64).tobytes(),
                                       b"".join(x["q"]), x["scale"].to_numpy().tobytes(), x["error"].to_numpy().tobytes()))
                        made += 1
            rest = kept
            yield pd.DataFrame(packed, columns=[x.split()[0] for x in BLOCKS.split(", ")])

    order = ["label", "dim", "place", "first"]
    placed = classes.select(*order, "q", "scale", "error").repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.mapInPandas(cut, BLOCKS)


def tile_pairs(block: DataFrame, threshold: float) -> DataFrame:
    """Pairs of vectors whose cosine may reach the threshold.

    Two blocks of a label meet once, unless their ranges on the block order are further apart
    than linked unit vectors can be.  The list of block pairs is narrow; the packed blocks are
    then joined to it by block number, so the tiles of a hot label spread over tasks."""
    apart = (2 - 2 * threshold) ** 0.5 + SLACK
    a, b = block.select("label", "dim", "block", "lo", "hi").alias("a"), block.select("label", "dim", "block", "lo", "hi").alias("b")
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.block") <= F.col("b.block"))
    near = (F.col("a.lo") - F.col("b.hi") <= apart) & (F.col("b.lo") - F.col("a.hi") <= apart)
    meet = a.join(b, same & near).select(F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    side = lambda key, tag: block.select(F.col("block").alias(key), "dim" if tag == "x" else F.lit(0).alias("_"), *[F.col(c).alias(f"{tag}_{c}") for c in ("ids", "q", "scale", "error")])
    tiles = meet.join(side("i", "x"), "i").join(side("j", "y"), "j").drop("_")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                read = lambda tag: (
                    np.frombuffer(t[f"{tag}_ids"], dtype="<i8"), np.frombuffer(t[f"{tag}_q"], dtype=np.int8).reshape(-1, t["dim"]),  # noqa: B023
                    np.frombuffer(t[f"{tag}_scale"]), np.frombuffer(t[f"{tag}_error"]),  # noqa: B023
                )
                (ia, *xa), (ib, *xb) = read("x"), read("y")
                may = upper_bounds(*xa, *xb) >= threshold
                r, c = np.nonzero(np.triu(may, 1) if t["i"] == t["j"] else may)
                yield pa.RecordBatch.from_arrays([pa.array(ia[r]), pa.array(ib[c])], ["a", "b"])

    return tiles.mapInArrow(multiply, "a long, b long")


def exact_links(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs with a cosine of at least ``threshold`` in double precision."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x), np.frombuffer(y)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                keep.append(bool(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    a = classes.select(F.col("first").alias("a"), F.col("vector").alias("x"))
    b = classes.select(F.col("first").alias("b"), F.col("vector").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def vector_components(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``label``, ``embedding``): ``vec_id``,
    ``n_links``, ``component_id``, ``kept``.

    Vectors are compared where labels are equal and lengths agree.  Rows with a NULL id or label,
    and vectors that are NULL, empty, zero or hold a NULL or non-finite component, link with
    nothing and are their own component.  Equal vectors shrink to one before any comparison and
    count one by one in ``n_links``.  Rows that repeat an id are vectors of their own.
    """
    vectors = vectors.select("vec_id", "label", "embedding")
    made = stored(prepare(vectors), "vectors")
    keep = ("label", "dim", "q", "scale", "error", "place", "vector")
    classes = stored(made.groupBy("class").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in keep]), "classes")
    pairs = tile_pairs(stored(blocks(classes), "blocks"), threshold)
    links = stored(exact_links(pairs, classes, threshold), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("first").alias("b"), "copies")
    others = both.join(size, "b").groupBy(F.col("a").alias("first")).agg(F.sum("copies").alias("_others"))
    label = components(links).select(F.col("node").alias("first"), "component")
    told = classes.select("class", "first", "copies").join(others, "first", "left").join(label, "first", "left")
    told = stored(told.select("class", (F.coalesce("_others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("_component")), "told")
    # A class may hold a third of all rows: its rows are spread over salts.
    salted = made.select("vec_id", "class").withColumn("_salt", row_hash_salt("vec_id"))
    found = salted.join(told.withColumn("_salt", all_salts()), ["class", "_salt"]).select("vec_id", "n_links", "_component")
    lone = vectors.select("vec_id", "label", "embedding").mapInArrow(_unusable, "vec_id long")
    lone = lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("_component"))
    out = found.unionByName(lone)
    return out.select("vec_id", "n_links", F.col("_component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("_component"), F.lit(False)).alias("kept"))


def _unusable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the rows that link with nothing."""
    for batch in batches:
        lone = np.ones(len(batch), dtype=bool)
        for rows, _ in usable_rows(batch):
            lone[rows] = False
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(lone)).cast(pa.int64())], ["vec_id"])
