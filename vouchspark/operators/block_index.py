"""Stored inverted index: postings in blocks of chunks, and bounds that say which blocks to skip.

Tables below one folder, each with a part ``batch=<n>`` per appended batch:

- ``words`` (word, term, code): every distinct word once, what it is indexed as, and its number.  Stems
  are made here, once per word; everything behind this table is integers.
- ``blocks``: one row per block of at most ``BLOCK`` chunks that are neighbours in version order: ids,
  versions and lengths of the chunks, and the postings as sorted arrays (code, place, tf).
- ``bounds`` (bucket, code, block, peak, n): the largest gain of a term in a block, and its chunks there.
- ``terms`` (term, code, df) and ``totals``.

A query batch adds up weight times peak per query and block.  The blocks that promise most are
scored first; the k-th best score found there is a floor, and a block whose promise stays below a
query's floor is not read for it.  Gains hang on the average length, which later batches move: a
peak grows at most with the ratio of the averages, so it is stretched by that and stays a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchspark.functions.text import stem_word, terms
from vouchspark.operators.scaling import first_rows, fits_broadcast, global_positions, measured_bytes, row_hash_salt
from vouchspark.session import release, reliable_checkpoint
from vouchspark.streaming.tables import remove_folders

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
SCORE_DIGITS = 6
#: Room for rounding when a bound is held against a score.
MARGIN = 1e-5
#: Chunks of a block, a power of two.
BLOCK_BITS = 3
BLOCK = 1 << BLOCK_BITS
#: Codes and blocks of a batch are numbered from its own start.
CODE_BITS, BATCH_BITS = 40, 46
#: Found rows that a task holds before it cuts them to the best.
HELD = 500_000
#: Blocks, and cells of a table of blocks and queries, that a task works on at once.
PIECE, CELLS = 256, 1_000_000
#: Words of the texts of a page, whose distinct words are numbered together.
PAGE_WORDS = 1_000_000


@dataclass(frozen=True)
class BlockIndex:
    """A stored index; ``totals`` has a row per batch."""

    blocks: DataFrame
    bounds: DataFrame
    terms: DataFrame
    totals: DataFrame
    buckets: int
    stem: bool


def gain(tf, dl, avgdl: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def inverse_frequency(df: Column, n: float) -> Column:
    idf = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(IDF_FLOOR)


def code_bucket(code: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(buckets)).cast("int")


def pieces(frames: Iterator[pd.DataFrame], cells: int = 1, most: int = PIECE) -> Iterator[pd.DataFrame]:
    """Frames cut to a few rows, with ``cells`` numbers a row: what a task holds besides a frame does
    not hang on the rows that Spark puts into one."""
    rows = max(1, min(most, CELLS // max(1, cells)))
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


# --- writing ------------------------------------------------------------------------------
def analysed(chunks: DataFrame) -> DataFrame:
    """Chunks with their words, unstemmed, and the number of these."""
    return chunks.select("chunk_id", "corpus_version", terms(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))


def placed(docs: DataFrame, path: str, batch: int) -> DataFrame:
    """``docs`` as rows of blocks, neighbours in version order in one; texts are cut into words where they
    have come to lie.  Stored, so that numbers cannot change.

    Some thousand neighbours are a page, which numbers its distinct words: a block has a word as its
    number there (``locals``) with ``places`` and ``tfs``, and the first block of a page has its ``words``.
    So what is still to be joined is a row for each distinct word of a page, not for each word."""
    order = ["corpus_version", "chunk_id"]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = analysed(rows) if "text" in rows.columns else rows
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("block", F.lit(batch << BATCH_BITS) + F.shiftright("_at", BLOCK_BITS)).withColumn("place", F.col("_at").bitwiseAND(BLOCK - 1).cast("int")).drop("_at")
    if "tfs" not in rows.columns:
        rows = rows.withColumn("tfs", F.lit(None).cast("array<int>"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = (
        f"page long, block long, first_version {kind['corpus_version']}, chunk_ids array<{kind['chunk_id']}>, versions array<{kind['corpus_version']}>, dls array<{kind['dl']}>, "
        f"locals array<int>, places array<tinyint>, tfs array<int>, words {kind['tokens']}"
    )
    paged = rows.select("block", "place", "chunk_id", "corpus_version", "dl", "tokens", "tfs").mapInArrow(pages, schema)
    paged.write.mode("overwrite").parquet(f"{path}/placed/batch={batch}")
    return docs.sparkSession.read.schema(paged.schema).parquet(f"{path}/placed/batch={batch}")


def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that lie in order, a page of whole blocks at a time."""
    held, words = [], 0
    for batch in batches:
        # In pieces, since a page ends where its words are enough.
        for at in range(0, len(batch), PIECE * BLOCK):
            held.append(batch.slice(at, PIECE * BLOCK))
            words += pc.sum(pc.list_value_length(held[-1].column("tokens"))).as_py() or 0
            last = np.flatnonzero(held[-1].column("place").to_numpy() == BLOCK - 1)
            if words >= PAGE_WORDS and len(last):
                rest = held[-1].slice(int(last[-1]) + 1)
                held[-1] = held[-1].slice(0, int(last[-1]) + 1)
                yield from page_blocks(pa.Table.from_batches(held))
                held, words = [rest] if len(rest) else [], pc.sum(pc.list_value_length(rest.column("tokens"))).as_py() or 0
    if held:
        yield from page_blocks(pa.Table.from_batches(held))


def _lists(ends: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def page_blocks(page: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of blocks of one page; its number is that of its first block."""
    numbers, place, tokens, tfs = page["block"].to_numpy(), page["place"].to_numpy(), _whole(page["tokens"]), _whole(page["tfs"])
    first = np.append(0, np.flatnonzero(numbers[1:] != numbers[:-1]) + 1)
    ends = np.append(first, len(numbers))
    many, row = len(first), pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
    named = tokens.flatten().dictionary_encode()
    code, size = named.indices.to_numpy().astype(np.int64), max(1, len(named.dictionary))
    counts = np.ones(len(code), dtype=np.int64) if tfs.null_count == len(tfs) else tfs.flatten().to_numpy()
    block, code, at, tf = _counted(np.repeat(np.arange(many), np.diff(ends))[row], code, place[row], counts, size)
    versions = _whole(page["corpus_version"])
    cuts = np.searchsorted(block, np.arange(many + 1))
    words = pa.ListArray.from_arrays(pa.array([0] + [len(named.dictionary)] * many, pa.int32()), named.dictionary, mask=pa.array([False] + [True] * (many - 1)))
    whole = pa.RecordBatch.from_arrays(
        [pa.array(np.full(many, numbers[0])), pa.array(numbers[first]), versions.take(pa.array(first)), _lists(ends, _whole(page["chunk_id"])), _lists(ends, versions), _lists(ends, _whole(page["dl"])),
         _lists(cuts, code.astype(np.int32)), _lists(cuts, at.astype(np.int8)), _lists(cuts, tf.astype(np.int32)), words],
        ["page", "block", "first_version", "chunk_ids", "versions", "dls", "locals", "places", "tfs", "words"],
    )
    for start in range(0, many, PIECE):
        yield whole.slice(start, PIECE)


def _counted(block: np.ndarray, code: np.ndarray, place: np.ndarray, tf: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Postings in order of block, code and place, each once, with their counts added up."""
    key, at = np.unique((block * size + code) * BLOCK + place, return_inverse=True)
    return key // BLOCK // size, key // BLOCK % size, key % BLOCK, np.bincount(at, weights=tf, minlength=len(key)).astype(np.int64)


def recoded(blocks: pa.Table, named: pa.Table) -> pa.Table:
    """Blocks of a page with the codes of the vocabulary in place of the page's own numbers."""
    codes, rank = np.unique(named["code"].to_numpy(), return_inverse=True)
    of = np.zeros(len(rank), dtype=np.int64)
    of[named["local"].to_numpy()] = rank
    lists = _whole(blocks["locals"])
    row, code = pc.list_parent_indices(lists).to_numpy().astype(np.int64), of[lists.flatten().to_numpy()]
    place, tf = (_whole(blocks[c]).flatten().to_numpy().astype(np.int64) for c in ("places", "tfs"))
    row, code, place, tf = _counted(row, code, place, tf, max(1, len(codes)))
    cuts = np.searchsorted(row, np.arange(len(blocks) + 1))
    kept = blocks.select(["block", "first_version", "chunk_ids", "versions", "dls"])
    for name, values in (("codes", codes[code]), ("places", place.astype(np.int32)), ("tfs", tf.astype(np.int32))):
        kept = kept.append_column(name, _lists(cuts, values))
    return kept


def write_words(words: DataFrame, path: str, batch: int, stem: bool) -> DataFrame:
    """Vocabulary of a batch: distinct ``word``, its ``term`` and the term's ``code``."""
    spark = words.sparkSession
    words = words.distinct()
    start = (batch << CODE_BITS) - 1
    if stem:
        words = reliable_checkpoint(words.withColumn("term", stem_word("word")))
        known = words.join(global_positions(words.select("term").distinct(), ["term"], "code", start), "term")
    else:
        known = global_positions(words.select(F.col("word").alias("term")), ["term"], "code", start).withColumn("word", F.col("term"))
    known.select("word", "term", "code").write.mode("overwrite").parquet(f"{path}/words/batch={batch}")
    return spark.read.parquet(f"{path}/words/batch={batch}")


def write_batch(docs: DataFrame, path: str, *, stem: bool, buckets: int, batch: int, names: DataFrame | None = None) -> None:
    """Index ``docs`` as one batch: (chunk_id, corpus_version, text) or, with ``names`` (code, term) of an
    older vocabulary, (chunk_id, corpus_version, dl, tokens, tfs) where tokens are its codes.

    Texts move once, to lie in version order.  Then the distinct words of each page are joined with
    the vocabulary, and the blocks of a page, in numbers, meet their codes.  A word is there once a
    page, so that none is a hot key, and no word of a text becomes a row.
    """
    spark = docs.sparkSession
    rows = placed(docs, path, batch)
    release(spark)
    lengths = rows.select(F.explode("dls").alias("dl"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))
    n, total = totals.first()
    avgdl = max(total / n, 1e-9) if n else 1.0
    listed = rows.filter("words is not null").select("page", F.posexplode("words").alias("local", "word"))
    if names is None:
        known = write_words(listed.select("word"), path, batch, stem).select("word", "code")
    else:
        fresh = write_words(names.select(F.col("term").alias("word")), path, batch, False).select("term", F.col("code").alias("_new"))
        known = names.join(fresh, "term").select(F.col("code").alias("word"), F.col("_new").alias("code"))
    named = listed.join(F.broadcast(known) if fits_broadcast(known) else known, "word").select("page", "local", "code")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"block long, first_version {kind['first_version']}, chunk_ids {kind['chunk_ids']}, versions {kind['versions']}, dls {kind['dls']}, codes array<long>, places array<int>, tfs array<int>"
    own = rows.drop("words").withColumnRenamed("page", "own_page")
    blocks = own.groupBy("own_page").cogroup(named.groupBy("page")).applyInArrow(recoded, schema)
    blocks.write.mode("overwrite").parquet(f"{path}/blocks/batch={batch}")
    release(spark)
    blocks = spark.read.schema(blocks.schema).parquet(f"{path}/blocks/batch={batch}")
    bounds = block_peaks(blocks, avgdl).withColumn("bucket", code_bucket(F.col("code"), buckets))
    spread = bounds.repartition(F.col("bucket"), row_hash_salt("block", salts=4))
    spread.sortWithinPartitions("bucket", "code").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/bounds/batch={batch}")
    release(spark)
    # An empty batch leaves no folder of a bucket behind, so the schema is given.
    counted = spark.read.schema(bounds.schema).parquet(f"{path}/bounds/batch={batch}").groupBy("code").agg(F.sum("n").alias("df"))
    named = spark.read.parquet(f"{path}/words/batch={batch}").select("term", "code").distinct()
    named.join(counted, "code").select("term", "code", "df").write.mode("overwrite").parquet(f"{path}/terms/batch={batch}")
    told = totals.withColumn("avgdl", F.lit(float(avgdl))).withColumn("stem", F.lit(stem)).withColumn("buckets", F.lit(buckets))
    told.write.mode("overwrite").parquet(f"{path}/totals/batch={batch}")
    remove_folders(spark, [f"{path}/placed"])
    release(spark)


def block_peaks(blocks: DataFrame, avgdl: float) -> DataFrame:
    """(code, block, peak, n) of blocks: the largest real gain and the number of chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            codes, places, tfs, dls = (np.concatenate([*frame[c], np.empty(0, dtype=np.int64)]) for c in ("codes", "places", "tfs", "dls"))
            if not len(codes):
                continue
            row = np.repeat(np.arange(len(frame)), frame["codes"].map(len))
            sizes = frame["dls"].map(len).to_numpy()
            gains = gain(tfs.astype(np.float64), dls[(np.cumsum(sizes) - sizes)[row] + places.astype(np.int64)].astype(np.float64), avgdl)
            first = np.append(0, np.flatnonzero((codes[1:] != codes[:-1]) | (row[1:] != row[:-1])) + 1)
            counts = np.diff(np.append(first, len(codes)))
            yield pd.DataFrame({"code": codes[first].astype(np.int64), "block": frame["block"].to_numpy()[row[first]], "peak": np.maximum.reduceat(gains, first), "n": counts})

    return blocks.select("block", "dls", "codes", "places", "tfs").mapInPandas(run, "code long, block long, peak double, n long")


def read_blocks(spark: SparkSession, path: str) -> BlockIndex:
    totals = spark.read.parquet(f"{path}/totals")
    found = totals.select("stem", "buckets").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("the parts of a stored index must agree in stem and buckets")
    bounds = spark.read.schema("code long, block long, peak double, n long, batch long, bucket int").parquet(f"{path}/bounds")
    return BlockIndex(
        spark.read.parquet(f"{path}/blocks").drop("batch"), bounds, spark.read.parquet(f"{path}/terms").drop("batch"),
        totals.select(F.col("batch").cast("long").alias("batch"), "n_chunks", "total_len", "avgdl"), found[0]["buckets"], found[0]["stem"],
    )


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write all batches of an index as one batch of a new folder: full blocks, one vocabulary, one
    set of files.  Words are not analysed or stemmed again; their codes are joined with new ones."""
    index = read_blocks(spark, path)
    kind = {f.name: f.dataType.simpleString() for f in index.blocks.schema.fields}
    schema = f"chunk_id {kind['chunk_ids'][6:-1]}, corpus_version {kind['versions'][6:-1]}, dl {kind['dls'][6:-1]}, tokens array<long>, tfs array<int>"
    docs = index.blocks.select("chunk_ids", "versions", "dls", "codes", "places", "tfs").mapInArrow(unpacked, schema)
    ids = index.blocks.select(F.explode("chunk_ids").alias("chunk_id"))
    repeated = reliable_checkpoint(ids.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and chunk_id is not null").select("chunk_id"))
    if not repeated.isEmpty():
        # Rows of one chunk have the words of all of them, each its own version and length.
        few = F.broadcast(repeated) if fits_broadcast(repeated) else repeated
        twice = docs.join(few, "chunk_id")
        every = twice.groupBy("chunk_id").agg(F.collect_list(F.struct("tokens", "tfs")).alias("_p"))
        every = every.select("chunk_id", F.flatten("_p.tokens").alias("tokens"), F.flatten("_p.tfs").alias("tfs"))
        docs = docs.join(few, "chunk_id", "left_anti").unionByName(twice.drop("tokens", "tfs").join(every, "chunk_id"))
    names = spark.read.parquet(f"{path}/words").select("code", "term").distinct()
    write_batch(docs, into, stem=False, buckets=index.buckets, batch=0, names=names)
    if index.stem:
        mark = spark.read.parquet(f"{into}/totals/batch=0").withColumn("stem", F.lit(True))
        reliable_checkpoint(mark).write.mode("overwrite").parquet(f"{into}/totals/batch=0")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of blocks, each with its own postings as codes and counts."""
    for batch in batches:
        for start in range(0, len(batch), PIECE):
            piece = batch.slice(start, PIECE)
            sizes, lists = pc.list_value_length(piece.column("chunk_ids")).to_numpy(), piece.column("codes")
            first = np.cumsum(sizes) - sizes
            chunk = first[pc.list_parent_indices(lists).to_numpy()] + piece.column("places").flatten().to_numpy()
            order = np.argsort(chunk, kind="stable")
            cuts = np.searchsorted(chunk[order], np.arange(sizes.sum() + 1))
            own = [_lists(cuts, piece.column(c).flatten().to_numpy()[order]) for c in ("codes", "tfs")]
            yield pa.RecordBatch.from_arrays([*(piece.column(c).flatten() for c in ("chunk_ids", "versions", "dls")), *own], ["chunk_id", "corpus_version", "dl", "tokens", "tfs"])


# --- asking -------------------------------------------------------------------------------
class Weights:
    """Weights of a batch of queries, by code."""

    def __init__(self, rows: pd.DataFrame):
        number, self.query_ids = pd.factorize(rows["query_id"])
        order = np.argsort(rows["code"].to_numpy(), kind="stable")
        code = rows["code"].to_numpy()[order]
        self.codes, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code))
        self.query, self.weight = number[order], rows["weight"].to_numpy()[order]
        self.until = np.full(len(self.query_ids), np.inf)
        self.until[number] = rows["until"].astype("float64").fillna(np.inf).to_numpy()

    def spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (entry of ``at``, row of the weights) of codes given by their number."""
        many = self.first[at + 1] - self.first[at]
        ends = np.cumsum(many)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - ends + many, many)
        return np.repeat(np.arange(len(at)), many), rows

    def reach(self, codes: list[np.ndarray], peaks: list[np.ndarray]) -> np.ndarray:
        """Largest possible score of every query (columns) in every block (rows)."""
        block = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        code, peak = (np.concatenate([*x, np.empty(0)]) for x in (codes, peaks))
        at = np.searchsorted(self.codes, code.astype(np.int64))
        each, rows = self.spread(at)
        cell = block[each] * len(self.query_ids) + self.query[rows]
        sums = np.bincount(cell, weights=self.weight[rows] * peak[each], minlength=len(codes) * len(self.query_ids))
        return sums.reshape(len(codes), len(self.query_ids))


class BlockScorer:
    """Scores of blocks, with the best ``k`` per query so far."""

    def __init__(self, weights: Weights, k: int, avgdl: float, latest: float, floor: np.ndarray | None = None):
        self.w, self.k, self.avgdl, self.latest = weights, k, avgdl, latest
        self.floor = np.full(len(weights.query_ids), -np.inf) if floor is None else floor.copy()
        self.place = np.full(len(weights.query_ids), -1)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def feed(self, queries, chunk_ids, versions, dls, codes, places, tfs) -> None:
        """Score one block for some queries."""
        w, many = self.w, len(chunk_ids)
        self.place[queries] = np.arange(len(queries))
        at = np.searchsorted(w.codes, codes)
        at[at == len(w.codes)] = 0
        wanted = np.flatnonzero(w.codes[at] == codes) if len(w.codes) else at[:0]
        at, places = at[wanted], places[wanted]
        gains = gain(tfs[wanted].astype(np.float64), dls[places].astype(np.float64), self.avgdl)
        post, row = w.spread(at)
        place = self.place[w.query[row]]
        asked = place >= 0
        post, row, place = post[asked], row[asked], place[asked]
        cells = np.bincount(place * many + places[post], weights=w.weight[row] * gains[post], minlength=len(queries) * many)
        scores = cells.reshape(len(queries), many)
        self.place[queries] = -1
        until = np.minimum(w.until[queries], self.latest)
        row, column = np.nonzero((scores > 0) & (scores + MARGIN >= self.floor[queries][:, None]) & (versions[None, :] <= until[:, None]))
        self.parts.append((queries[row], np.round(-scores[row, column], SCORE_DIGITS), np.asarray(chunk_ids, dtype=object)[column]))
        self.held += len(row)
        if self.held > HELD:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = first_k(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.k) if self.parts else (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object))
        last = np.flatnonzero(np.bincount(found[0], minlength=len(self.floor)) == self.k)
        self.floor[last] = np.maximum(self.floor[last], -found[1][np.searchsorted(found[0], last, side="right") - 1])
        self.parts, self.held = [found], len(found[0])
        return found

    def frame(self) -> pd.DataFrame:
        query, value, ids = self.cut()
        return pd.DataFrame({"query_id": self.w.query_ids[query], "chunk_id": ids, "score": value})


def first_k(query: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` smallest values per query, ties by id, in order."""
    tie = np.unique(ids, return_inverse=True)[1] if len(ids) else np.empty(0, dtype=np.int64)
    order = np.lexsort((tie, value, query))
    query, value, ids = query[order], value[order], ids[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], value[keep], ids[keep]


def statistics(index: BlockIndex, vocabulary: DataFrame, within: int | None) -> tuple[DataFrame, int, int]:
    """(term, code, df) of the wanted terms (df over all batches), chunks and their total length.
    ``within`` counts a snapshot alone, from the versions in the blocks."""
    known = index.terms.join(vocabulary, "term", "left_semi")
    if within is None:
        n, total = index.totals.agg(F.sum("n_chunks"), F.sum("total_len")).first()
        sums = known.groupBy("term").agg(F.sum("df").alias("df"))
    else:
        live = index.blocks.filter(F.col("first_version") <= within)
        whole = live.select(F.explode(F.arrays_zip("versions", "dls")).alias("c")).filter(F.col("c.versions") <= within)
        n, total = whole.agg(F.count(F.lit(1)), F.sum("c.dls")).first()
        posts = live.select("versions", F.explode(F.arrays_zip("codes", "places")).alias("p"))
        posts = posts.filter(F.get("versions", F.col("p.places")) <= within).select(F.col("p.codes").alias("code"))
        sums = posts.join(known.select("term", "code"), "code").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return known.select("term", "code").join(sums, "term"), n or 0, total or 0


def promising(index: BlockIndex, weights: DataFrame, avgdl: float) -> DataFrame:
    """(block, codes, peaks) of all blocks with a wanted term.  Only the folders of wanted codes are
    read: at most ``buckets`` numbers come to the driver."""
    codes = weights.select("code").distinct()
    needed = [r["b"] for r in codes.select(code_bucket(F.col("code"), index.buckets).alias("b")).distinct().collect()]
    stretch = F.greatest(F.lit(1.0), F.lit(avgdl) / F.col("avgdl"))
    found = index.bounds.filter(F.col("bucket").isin(needed)).join(F.broadcast(codes), "code", "left_semi")
    found = found.join(F.broadcast(index.totals.select("batch", "avgdl")), "batch").select("block", "code", (F.col("peak") * stretch).alias("peak"))
    return reliable_checkpoint(found.groupBy("block").agg(F.collect_list("code").alias("codes"), F.collect_list("peak").alias("peaks")))


def seeds(reachable: DataFrame, sent, k: int) -> DataFrame:
    """(block, queries): for every query the blocks that promise most, enough to hold ``k`` chunks."""
    many = 1 + 4 * k // BLOCK

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames, cells=len(sent.value.query_ids)):
            reach, blocks = sent.value.reach(frame["codes"].tolist(), frame["peaks"].tolist()), frame["block"].to_numpy()
            best = np.argsort(-reach, axis=0, kind="stable")[:many]
            row, query = best.ravel(), np.tile(np.arange(reach.shape[1]), len(best))
            yield pd.DataFrame({"block": blocks[row], "query": query, "reach": reach[row, query]})

    listed = reachable.mapInPandas(run, "block long, query long, reach double").filter("reach > 0")
    listed = first_rows(listed, ["query"], [F.col("reach").desc(), F.col("block")], many, "_at")
    return listed.groupBy("block").agg(F.sort_array(F.collect_list("query")).alias("queries"))


def survivors(reachable: DataFrame, sent, floor: np.ndarray) -> DataFrame:
    """(block, queries): the queries that may find one of their best ``k`` in a block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames, cells=len(sent.value.query_ids)):
            reach = sent.value.reach(frame["codes"].tolist(), frame["peaks"].tolist())
            open_ = (reach > 0) & (reach + MARGIN >= floor)
            rows = np.flatnonzero(open_.any(axis=1))
            yield pd.DataFrame({"block": frame["block"].to_numpy()[rows], "queries": [np.flatnonzero(open_[r]) for r in rows]})

    return reachable.mapInPandas(run, "block long, queries array<long>")


def scored(index: BlockIndex, asked: DataFrame, sent, k: int, avgdl: float, latest: int | None, kinds: str, floor: np.ndarray | None = None) -> DataFrame:
    """Best ``k`` (query_id, chunk_id, score) per query and task over the blocks of ``asked``."""
    small = fits_broadcast(asked)
    rows = index.blocks if latest is None else index.blocks.filter(F.col("first_version") <= latest)
    rows = rows.join(F.broadcast(asked) if small else asked, "block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = BlockScorer(sent.value, k, avgdl, np.inf if latest is None else latest, floor)
        for frame in frames:
            for row in zip(*(frame[c] for c in ("queries", "chunk_ids", "versions", "dls", "codes", "places", "tfs")), strict=True):
                scorer.feed(*row)
        yield scorer.frame()

    return rows.select("queries", "chunk_ids", "versions", "dls", "codes", "places", "tfs").mapInPandas(run, kinds)


def blocks_topk(
    wanted: DataFrame, index: BlockIndex, k: int, *, corpus_version: int | None, within: int | None, as_of: DataFrame | None, broadcast_bytes: int
) -> DataFrame:
    """Best ``k`` (query_id, chunk_id, score) per query and task for ``wanted`` (query_id, term, qtf).

    Weights of a query batch are broadcast behind a size check; beyond it queries go in groups,
    each with its own pass over the bounds and over the blocks that it cannot skip.
    """
    vocabulary = wanted.select("term").distinct()
    known, n, total = statistics(index, F.broadcast(vocabulary) if fits_broadcast(vocabulary) else vocabulary, within)
    avgdl = max(total / n, 1e-9) if n else 1.0
    weights = wanted.join(known, "term").select("query_id", "code", (F.col("qtf") * inverse_frequency(F.col("df"), n)).alias("weight"))
    until = F.lit(None).cast("long").alias("until")
    if as_of is not None:
        weights, until = weights.join(as_of, "query_id"), F.col("as_of").cast("long").alias("until")
    weights = reliable_checkpoint(weights.select("query_id", "code", "weight", until))
    kind = {f.name: f.dataType.simpleString() for f in [*weights.schema.fields, *index.blocks.schema.fields]}
    kinds = f"query_id {kind['query_id']}, chunk_id {kind['chunk_ids'][6:-1]}, score double"
    queries, size = weights.select("query_id").distinct().count(), measured_bytes(weights)
    groups = min(queries, -(-size // max(1, broadcast_bytes)))
    out = None
    for group in range(groups):
        own = weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group)
        found = _group_topk(own, index, k, avgdl, corpus_version, kinds)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return weights.sparkSession.createDataFrame([], kinds) if out is None else out


def _group_topk(weights: DataFrame, index: BlockIndex, k: int, avgdl: float, latest: int | None, kinds: str) -> DataFrame | None:
    local = weights.toPandas()
    if not len(local):
        return None
    table = Weights(local)
    sent = weights.sparkSession.sparkContext.broadcast(table)
    reachable = promising(index, weights, avgdl)
    first = scored(index, reliable_checkpoint(seeds(reachable, sent, k)), sent, k, avgdl, latest, kinds)
    floors = first_rows(first, ["query_id"], [F.col("score"), F.col("chunk_id")], k, "_at").filter(F.col("_at") == k).select("query_id", "score").toPandas()
    floor = np.full(len(table.query_ids), -np.inf)
    floor[pd.Index(table.query_ids).get_indexer(floors["query_id"])] = -floors["score"].to_numpy()
    return scored(index, reliable_checkpoint(survivors(reachable, sent, floor)), sent, k, avgdl, latest, kinds, floor)
