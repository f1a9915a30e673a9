"""Self-join of documents by the Jaccard similarity of their word n-grams.

Exact copies shrink to one class first.  Any two sets with similarity of 0.8 or more share one
of their first tokens in a global order (prefix filter); the order puts frequent tokens last.
Rows that share such a token meet in tiles of one size band and its lower neighbour.  Inside a
tile every set has a hashed bitmap: the bits in which two bitmaps differ bound the overlap from
above, and only pairs that can still reach the threshold go on to the exact intersection of
their sorted arrays.  A bit of a bitmap is the parity of the tokens that hash to it, so that a
bit per token tells sets apart where bits that are merely set would all be taken.

Tokens whose documents all share one other token bring no new pair and are left out first.
Sets that are already connected need not meet again, which keeps groups of near copies from
growing into all their pairs.  So two rounds first link every row to pivots of its token and
band: to the smallest id, then to the set with the most links and to others that differ from
token to token.  The tiles compare rows of different components only, and a tile with very many rows is
cut into blocks: rows outside its largest component meet that component block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchspark.llm.graph import components
from vouchspark.llm.storage import stored
from vouchspark.llm.worker import batches_of, word_hashes
from vouchspark.operators.scaling import all_salts, fits_broadcast, row_hash_salt

WORDS = 5
#: Links need ``PART`` hundredths of the union.
PART = 80
#: Frequencies for the global order are kept per hash bucket, a table of fixed size.
COUNT_BITS = 16
BLOCK_ROWS = 2048
#: Rows of texts, sketches or pairs of sets that a worker gets at once.
BATCH_ROWS = 1000
#: Rows of tiles that are compared at once, at least.
STEP_ROWS = 10_000
#: Bits of a bitmap per token of the largest set of its band, at least; tiles carry whole ones.
LOAD = 1
THIN = LOAD
#: Pivots of a token and band that differ from token to token.
MIXED_PIVOTS = 3
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words; fewer words make one run."""
    words = word_hashes(text).view(np.uint64)
    n = min(WORDS, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    many = len(words) - n + 1
    total = np.full(many, n, dtype=np.uint64)
    for k in range(n):
        total = _mixed(total + words[k : k + many] * _FACTORS[k])
    return np.unique(total)


def least_overlap(n: int) -> int:
    """Smallest overlap of a set of ``n`` with any set it links with."""
    return -(-PART * n // 100)


def size_band(n: Column) -> Column:
    """Sizes of linked sets are in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / PART)).cast("int")


def _band(n: int) -> int:
    return math.floor(math.log(n) / math.log(100 / PART))


def bitmap_bits(band: int, load: int) -> int:
    """Width of the bitmaps in the tiles of a band, a power of two."""
    return max(64, 1 << math.ceil(math.log2(load * (100 / PART) ** (band + 1))))


def bitmap(hashes: np.ndarray, load: int) -> bytes:
    """Bitmap as wide as the band above needs; the difference of its halves is the narrower one."""
    width = bitmap_bits(_band(len(hashes)) + 1, load)
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _texts(docs: DataFrame) -> DataFrame:
    """UTF-8 bytes: words are cut at six ASCII blanks and A-Z alone is lower-cased."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Number of sets that hold a token of each hash bucket, over all documents.  Every task sends
    one number per bucket at most, and the driver gets 2^16 sums, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(1):
                total += np.bincount((shingles(text.as_py()) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = _texts(docs).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    counts[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def sketches(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Per document: ``n`` (set size), ``class`` (128-bit hash of the set), ``prefix`` (its first
    tokens in the global order) and ``bits`` (bitmap); all but ``n`` are NULL without words."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        for batch in batches:
            sizes, classes, prefixes, maps = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                n = len(own)
                sizes.append(n)
                if not n:
                    classes.append(None), prefixes.append(None), maps.append(None)
                    continue
                # np.unique sorted the hashes, and a stable sort keeps them in order within a rank.
                order = np.argsort(ranks[(own >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")
                classes.append(xxhash.xxh3_128_digest(own.tobytes()))
                prefixes.append(own[order[: n - least_overlap(n) + 1]].view(np.int64))
                maps.append(bitmap(own, LOAD))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                ["doc_id", "n", "class", "prefix", "bits"],
            )

    return _texts(docs).mapInArrow(sketch, "doc_id long, n long, class binary, prefix array<long>, bits binary")


def can_link(n_a: np.ndarray, n_b: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Each bit of differing parity stands for a token that one set lacks: the overlap is at most
    half of what the sizes exceed the differing bits by."""
    total = n_a + n_b
    return (100 + PART) * (total - differing) >= 2 * PART * total


def _differing(x: bytes, y: bytes) -> int:
    words = min(len(x), len(y)) // 8
    x, y = (np.bitwise_xor.reduce(np.frombuffer(m, dtype="<u8").reshape(-1, words), axis=0) for m in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _matrix(maps: pa.Array, words: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the asked width."""
    out = np.zeros((len(maps), words), dtype=np.uint64)
    for i, m in enumerate(maps.to_pylist()):
        row = np.frombuffer(m, dtype="<u8")
        out[i] = np.bitwise_xor.reduce(row.reshape(-1, words), axis=0) if len(row) > words else row
    return out


def bitmap_filter(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of one or two neighbouring size bands whose bitmaps leave room for a link.

    Only bitmaps of the documents in ``pairs`` move: their ids are broadcast to the sketches where
    they are measured to be few."""
    pairs = stored(pairs, "asked")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sketch = sketch.join(F.broadcast(ids) if fits_broadcast(ids) else ids, "doc_id", "left_semi")
    one = sketch.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    two = sketch.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ba, bb = (batch.column(c) for c in ("a", "b", "na", "nb", "ba", "bb"))
            differing = np.fromiter((_differing(x, y) for x, y in zip(ba.to_pylist(), bb.to_pylist(), strict=True)), dtype=np.int64, count=len(batch))
            keep = pa.array(can_link(na.to_numpy(), nb.to_numpy(), differing))
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(narrow, "a long, b long")


def exact_links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that really link, by intersecting the sorted arrays of their hashes.

    Arrays are made anew from the texts of the documents in ``pairs`` alone.  Their ids are
    broadcast where they are measured to be few, so that no text moves; else texts are joined.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = F.broadcast(ids) if fits_broadcast(ids) else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "own"])

    arrays = stored(_texts(docs).join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, own binary"), "sets")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PART * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    a = arrays.select(F.col("doc_id").alias("a"), F.col("own").alias("x"))
    b = arrays.select(F.col("doc_id").alias("b"), F.col("own").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(intersect, "a long, b long")


def shared_tokens(sketch: DataFrame) -> DataFrame:
    """``token``, ``doc_id``, ``band`` of prefix tokens that a document shares with one of a size
    it can link with.  One shuffle of narrow rows; in the order of sizes of its token a row only
    looks at its neighbours."""
    rows = sketch.select("doc_id", "n", F.explode("prefix").alias("token"))
    order = Window.partitionBy("token").orderBy("n", "doc_id")
    near = rows.withColumn("_less", F.lag("n").over(order)).withColumn("_more", F.lead("n").over(order))
    near = near.filter((100 * F.col("_less") >= PART * F.col("n")) | (PART * F.col("_more") <= 100 * F.col("n")))
    return near.select("token", "doc_id", size_band(F.col("n")).alias("band"))


def leading_tokens(rows: DataFrame) -> DataFrame:
    """Rows without the tokens that bring no pair of their own.

    Every document names its most frequent shared token.  Where all documents of a token name
    the same other one, they share that one as well, so every pair of the token is met there.  A
    token that some document names is never left out, since that document names no other.
    """
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_c"))
    counted = rows.join(counts, "token")
    named = counted.groupBy("doc_id").agg(F.max_by("token", F.struct("_c", "token")).alias("_best"))
    told = rows.join(named, "doc_id")
    bare = told.groupBy("token").agg(F.min("_best").alias("_lo"), F.max("_best").alias("_hi")).filter("_lo <> _hi or _lo = token").select("token")
    return rows.join(bare, "token")


def labelled(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """Add ``label`` (component so far) and ``degree`` (links so far)."""
    if links is None:
        return rows.withColumn("label", F.col("doc_id")).withColumn("degree", F.lit(0).cast("long"))
    ends = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
    node = stored(ends.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id"), "nodes")
    out = rows.join(node, "doc_id", "left")
    return out.withColumn("label", F.coalesce("component", "doc_id")).withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).drop("component")


def open_rows(rows: DataFrame) -> DataFrame:
    """Rows of tokens that documents of different components share.  A token of two documents of
    one band is settled by its pivot."""
    tokens = rows.groupBy("token").agg(
        F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("rows"), F.min("band").alias("_b"), F.max("band").alias("_c")
    )
    return rows.drop("rows").join(tokens.filter("_lo <> _hi and (rows > 2 or _b <> _c)").select("token", "rows"), "token")


def pivot_pairs(rows: DataFrame, *orders: Column) -> DataFrame:
    """Each document of labelled rows with the pivots of its token and band (the first by each of
    ``orders``), unless both are connected already."""
    firsts = [F.min_by(F.struct("doc_id", "label"), order) for order in orders]
    pivots = rows.groupBy("token", "band").agg(F.array_distinct(F.array(*firsts)).alias("_all"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    pivots = pivots.filter("_lo <> _hi").select("token", "band", "_all")
    met = rows.join(pivots, ["token", "band"]).withColumn("_p", F.explode("_all")).filter(F.col("label") != F.col("_p.label"))
    return met.select(F.least("doc_id", "_p.doc_id").alias("a"), F.greatest("doc_id", "_p.doc_id").alias("b")).distinct()


def tile_rows(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """Rows of all tiles in which documents of different components meet, from ``open_rows``.

    A document of a band is at home in the tiles of that band and a guest in those of the band
    above.  ``gi``, ``gj`` name the block pair, ``side`` tells its two blocks apart (0 in a group
    that is compared within itself).
    """
    # The largest component of tokens that many documents share.
    large = rows.filter(F.col("rows") > BLOCK_ROWS).groupBy("token", "label").agg(F.count(F.lit(1)).alias("_n"))
    main = large.groupBy("token").agg(F.max_by("label", F.struct("_n", "label")).alias("_main"), F.max("_n").alias("_main_rows"))
    zero = F.lit(0).cast("int")
    few = rows.filter(F.col("rows") <= BLOCK_ROWS).select("doc_id", "label", "token", zero.alias("gi"), zero.alias("gj"), zero.alias("side"))
    many = rows.filter(F.col("rows") > BLOCK_ROWS).join(main, "token")
    heavy = F.ceil(F.col("_main_rows") / BLOCK_ROWS).cast("int")
    light = F.greatest(F.lit(1), F.ceil((F.col("rows") - F.col("_main_rows")) / BLOCK_ROWS).cast("int"))
    mix = F.xxhash64("doc_id", "token")
    in_main = F.col("label") == F.col("_main")
    # Blocks of the main component are numbered below 0; each meets every block of the others.
    place = F.when(in_main, -1 - F.pmod(mix, heavy)).otherwise(F.pmod(mix, light)).cast("int")
    meets = F.when(in_main, F.sequence(zero, light - 1)).otherwise(F.concat(F.sequence(-heavy, F.lit(-1)), F.sequence(zero, light - 1)))
    many = many.withColumn("_own", place).withColumn("_other", F.explode(meets))
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(lo == hi, 0).when(F.col("_own") == lo, 1).otherwise(2)
    many = many.select("doc_id", "label", "token", lo.alias("gi"), hi.alias("gj"), side.cast("int").alias("side"))
    narrow = sketch.select("doc_id", "n", "bits", size_band(F.col("n")).alias("band"))
    # A guest is needed only where the token has documents of the band above.
    bands = rows.groupBy("token").agg(F.collect_set("band").alias("_bands"))
    placed = few.unionByName(many).join(bands, "token").join(narrow, "doc_id")
    homes = F.when(F.array_contains("_bands", F.col("band") + 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    return placed.withColumn("home", F.explode(homes)).withColumn("tile", F.col("band") + F.when(F.col("home"), 0).otherwise(1)).drop("_bands")


def tile_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of different components that the bitmaps of their tile leave possible.

    Rows of a tile's group come sorted by size.  All groups of a batch are compared at once, row
    ``i`` with row ``i + d`` for growing ``d``, as long as sizes allow a link.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if len(whole) < STEP_ROWS:
                rest = whole
                continue
            group = _groups(whole)
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            rest = whole.slice(cut).combine_chunks()
            yield from _compared(whole.slice(0, cut), group[:cut])
        if rest is not None:
            yield from _compared(rest, _groups(rest))

    keys = ["tile", "token", "gi", "gj"]
    placed = rows.select(*keys, "n", "doc_id", "label", "side", "home", "bits").repartition(*keys).sortWithinPartitions(*keys, "n", "doc_id")
    return placed.mapInArrow(compare, "a long, b long").distinct()


def _groups(rows: pa.Table) -> np.ndarray:
    """Running number of the group of each sorted row."""
    if not len(rows):
        return np.empty(0, dtype=np.int64)
    change = np.zeros(len(rows), dtype=bool)
    for key in ("tile", "token", "gi", "gj"):
        values = rows.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def _compared(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    tile = rows.column("tile").to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        part = rows.slice(lo, hi - lo)
        n, doc, label, side, home = (part.column(c).to_numpy() for c in ("n", "doc_id", "label", "side", "home"))
        own = group[lo:hi]
        bits = _matrix(part.column("bits").combine_chunks(), bitmap_bits(int(tile[lo]), THIN) // 64)
        left, found = np.arange(hi - lo), []
        for d in range(1, hi - lo):
            # Sizes rise within a group: a row that cannot link with row i + d ends there.
            left = left[left + d < hi - lo]
            right = left + d
            going = (own[left] == own[right]) & (PART * n[right] <= 100 * n[left])
            left, right = left[going], right[going]
            if not len(left):
                break
            ask = (label[left] != label[right]) & (home[left] | home[right]) & ((side[left] == 0) | (side[left] != side[right]))
            i, j = left[ask], right[ask]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                differing = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                keep = can_link(n[x], n[y], differing)
                if keep.any():
                    found.append(np.stack([np.minimum(doc[x], doc[y])[keep], np.maximum(doc[x], doc[y])[keep]]))
        if found:
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest id that links reach, the document itself included.  A text
    without words has no shingles and links with nothing, and so does a row with a NULL id (its
    component is NULL).  Rows that repeat an id are one document to the links: it links where
    any of its texts does.  All that runs in Python is stored here, in small batches.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _components(docs.select("doc_id", "text"))


def _components(docs: DataFrame) -> DataFrame:
    known = docs.filter(F.col("doc_id").isNotNull())
    made = stored(sketches(docs, shingle_counts(docs)), "sketches")
    classes = made.filter(F.col("class").isNotNull() & F.col("doc_id").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n"))
    copies = stored(classes.filter("_n > 1").select("class", "first"), "copies")
    # One document per class goes on: the copies that are not its first are listed, narrow, and left out.
    salted = made.filter("n > 0 and doc_id is not null").select("doc_id", "class").withColumn("_salt", row_hash_salt("doc_id"))
    met = salted.join(copies.withColumn("_salt", all_salts()), ["class", "_salt"])
    repeats = stored(met.filter("first <> doc_id").select("doc_id", "class").distinct(), "repeats")
    known_class = made.filter("n > 0 and doc_id is not null")
    single = known_class.join(F.broadcast(repeats) if fits_broadcast(repeats) else repeats, ["doc_id", "class"], "left_anti").select("doc_id", "n", "prefix", "bits")
    rows, links = stored(leading_tokens(stored(shared_tokens(single), "shared")), "leading"), None
    mixed = [F.struct(F.xxhash64("doc_id", "token", F.lit(k)), "doc_id") for k in range(MIXED_PIVOTS)]
    for orders in ([F.struct("doc_id")], [F.struct(-F.col("degree"), "doc_id"), *mixed]):
        if links is not None:
            rows = stored(open_rows(labelled(rows.select("token", "doc_id", "band"), links)), "open")
        else:
            rows = labelled(rows, None)
        near = stored(bitmap_filter(pivot_pairs(rows, *orders), single), "pairs")
        found = exact_links(near, known)
        links = stored(found if links is None else links.unionByName(found), "links")
    rows = stored(open_rows(labelled(rows.select("token", "doc_id", "band"), links)), "open")
    tiled = stored(bitmap_filter(tile_pairs(tile_rows(rows, single)), single), "pairs")
    label = stored(components(links.unionByName(exact_links(tiled, known))), "components")
    # Copies take the component of the first of their class.
    of_class = copies.join(label.withColumnRenamed("node", "first"), "first", "left").select("class", F.coalesce("component", "first").alias("_of_class"))
    out = made.select("doc_id", "n", "class").withColumn("_salt", row_hash_salt("doc_id"))
    out = out.join(of_class.withColumn("_salt", all_salts()), ["class", "_salt"], "left")
    out = out.join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_of_class", "component", "doc_id")).alias("component_id"))
