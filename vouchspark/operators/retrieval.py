"""Batch retrieval: inverted index, BM25, exact nearest neighbours, rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchspark.functions.text import ACCENTED, ASCII_FOLDS, PLAIN, folds_to_ascii, query_terms, stem_word, terms_of
from vouchspark.operators import block_index as S
from vouchspark.operators.block_index import B, K1, MARGIN, SCORE_DIGITS, BlockIndex, analysed, inverse_frequency
from vouchspark.operators.block_index import first_k as _first_k
from vouchspark.operators.block_index import pieces
from vouchspark.operators.corpus import EmbedFn, as_of
from vouchspark.operators.scaling import (
    BROADCAST_BYTES, first_rows, fits_broadcast, measured_bytes, row_hash_salt, salted_join,
)
from vouchspark.session import reliable_checkpoint, stored

FUSION_K = 60


# Stands for the whole corpus in a table of terms; an analysed term is never empty.
ALL_TERMS = ""


@dataclass(frozen=True)
class Index:
    """``postings(term, chunk_id, tf, dl, corpus_version)`` of chunks that were just analysed, not moved
    anywhere.  Chunk length and version ride along in each posting, so scoring joins nothing back.
    ``docs`` are the chunks with their unstemmed words, ``texts`` with their texts (``chunks`` in any index,
    to be stored); ``stems`` (word, term) is set in a stemmed index,
    and so are ``words``, a row per unstemmed word of a chunk.  ``held`` keeps the chunks as they were
    last coded for questions (see ``coded``), since several steps ask an index the same words.
    """

    postings: DataFrame
    docs: DataFrame
    stems: DataFrame | None = None
    words: DataFrame | None = None
    texts: DataFrame | None = None
    chunks: DataFrame | None = None
    held: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def stem(self) -> bool:
        return self.stems is not None

    def coded(self, words: list[str]) -> tuple[list[str], DataFrame]:
        """Words, ``words`` among them, and the stored chunks coded for them."""
        if not set(words) <= set(self.held.get("words", ())) or "rows" not in self.held:
            self.held.update(words=words, rows=stored(coded(self.texts, words)))
        return self.held["words"], self.held["rows"]

    def matching(self, vocabulary: DataFrame, small: bool) -> DataFrame:
        """Postings of the terms of ``vocabulary``.  A stemmed index joins only the words that have one
        of these stems, so that words nobody asks for are dropped where they lie, not shuffled to
        their stem first."""
        if self.stems is None or self.words is None:
            return self.postings.join(_hinted(vocabulary, small), "term", "left_semi")
        return _counted(_stemmed(self.words, self.stems.join(_hinted(vocabulary, small), "term", "left_semi")))


def build_index(chunks: DataFrame, *, stem: bool = False) -> Index:
    """Inverted index of ``chunks(chunk_id, corpus_version, text)``.

    The chunk texts are spread by chunk id once.  Everything a chunk needs afterwards, the
    count per term and later its score for every query, is grouped by that id as well, so
    it needs no further shuffle; postings, several times larger than the text, stay put.

    Stems are made once per distinct word, in a table of its own that is joined back
    (broadcast behind a size check, else over salts).  That runs two jobs.
    """
    texts = chunks.select("chunk_id", "corpus_version", "text")
    docs, placed = analysed(texts), analysed(texts.repartition("chunk_id"))
    # The outer form keeps Spark from adding a filter that would analyse every text twice.
    words = placed.select("chunk_id", "corpus_version", "dl", F.explode_outer("tokens").alias("term")).filter(F.col("term").isNotNull())
    if stem:
        listed = docs.select(F.explode("tokens").alias("word")).distinct()
        stems = reliable_checkpoint(listed.select("word", stem_word("word").alias("term")))
        words = words.withColumnRenamed("term", "word")
        return Index(_counted(_stemmed(words, stems)), docs, stems, words, chunks=texts)
    return Index(_counted(words), docs, texts=texts, chunks=texts)


def _stemmed(words: DataFrame, stems: DataFrame) -> DataFrame:
    return words.join(F.broadcast(stems), "word") if fits_broadcast(stems) else salted_join(words, stems, "word", "inner", ["chunk_id"])


def _counted(words: DataFrame) -> DataFrame:
    return words.groupBy("chunk_id", "corpus_version", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def index_totals(index: Index | BlockIndex) -> DataFrame:
    """One row: number of chunks and sum of their lengths."""
    if isinstance(index, BlockIndex):
        return index.totals.agg(F.sum("n_chunks").alias("n_chunks"), F.sum("total_len").alias("total_len"))
    return index.docs.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("dl").alias("total_len"))


def term_statistics(index: Index, matched: DataFrame, version: int | None = None) -> DataFrame:
    """(term, df, total_len): chunks per term, and the corpus totals in the row ALL_TERMS.

    Without stems both come from one pass over the chunks: the distinct words of a chunk are
    taken inside its row, so only one counter per term is shuffled.  Two words of a chunk may
    share a stem, so with stems the chunks are counted in the postings of the wanted terms.
    """
    live = as_of(index.docs, version)
    if not index.stem:
        words = F.explode(F.concat(F.array(F.lit(ALL_TERMS)), F.array_distinct("tokens")))
        return live.select("dl", words.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total_len"))
    counted = matched.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.lit(0).cast("long").alias("total_len"))
    return counted.unionByName(live.agg(F.lit(ALL_TERMS).alias("term"), F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total_len")))


def coded(chunks: DataFrame, words: list[str]) -> DataFrame:
    """One row per row of ``chunks`` with the asked words in it: (chunk_id, corpus_version, dl, codes, tfs),
    ``codes`` being places in ``words``, rising, and ``tfs`` how often each occurs.  Words that nobody
    asks for are dropped inside the row, so that no row per word is made.  Texts that are ASCII once they
    are folded are folded and cut into words a batch at a time, only others by the pattern."""
    sent = chunks.sparkSession.sparkContext.broadcast(words)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, many = pa.array(sent.value, pa.string()), max(1, len(sent.value))
        for batch in batches:
            dl, pairs = np.zeros(len(batch), dtype=np.int64), []
            for lists in (_plain_words(batch.column("plain")), batch.column("tokens")):
                flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                dl += np.bincount(row[pc.not_equal(flat, pa.scalar("", flat.type)).to_numpy(zero_copy_only=False)], minlength=len(batch))
                at = pc.fill_null(pc.index_in(flat, value_set=asked.cast(flat.type)), -1).to_numpy()
                pairs.append(row[at >= 0] * many + at[at >= 0])
            pair, count = np.unique(np.concatenate(pairs), return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(len(batch) + 1) * many).astype(np.int32))
            codes, tfs = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((pair % many).astype(np.int32), count.astype(np.int64)))
            unknown = pc.and_(batch.column("plain").is_null(), batch.column("tokens").is_null()).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), batch.column("corpus_version"), pa.array(dl.astype(np.int32), mask=unknown), codes, tfs],
                ["chunk_id", "corpus_version", "dl", "codes", "tfs"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    schema = f"chunk_id {kinds['chunk_id']}, corpus_version {kinds['corpus_version']}, dl int, codes array<int>, tfs array<long>"
    lowered = F.col("lowered")
    plain = (F.octet_length(lowered) == F.length(lowered)) | folds_to_ascii(lowered)
    texts = chunks.select("chunk_id", "corpus_version", F.lower("text").alias("lowered")).select(
        "chunk_id", "corpus_version", F.when(plain, lowered).alias("plain"), F.when(~plain, terms_of(F.translate(lowered, ACCENTED, PLAIN))).alias("tokens")
    )
    return texts.mapInArrow(code, schema)


#: What an ASCII character of a folded text counts as: letters and digits themselves, all else a blank.
_PLAIN = np.array([c if chr(c).isalnum() and c < 128 else 32 for c in range(256)], dtype=np.uint8)
#: The same for characters of a lower-cased text that fold to ASCII; 0 for those that fold to nothing.
_FOLDED = np.concatenate([_PLAIN, np.full(0x2000 - 256, 32, dtype=np.uint8)])
_FOLDED[[ord(c) for c in ASCII_FOLDS]] = [_PLAIN[ord(to)] if to else 0 for to in ASCII_FOLDS.values()]


def _plain_words(texts: pa.Array) -> pa.ListArray:
    """Words of lower-cased texts that fold to ASCII, cut at blanks instead of by a pattern; blanks at an
    end of a text leave an empty word there, and a NULL text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, ends = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    if len(data) and data.max() > 127:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        body = _FOLDED[points]
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
        ends, body = np.concatenate([[0], np.cumsum(body > 0)])[ends], body[body > 0]
    else:
        body = _PLAIN[data]
    return pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)))


def write_index(index: Index, path: str, buckets: int = 256, *, batch: int = 0) -> None:
    """Store an index once for many query batches; ``batch`` numbers an appended part."""
    S.write_batch(index.chunks, path, stem=index.stem, buckets=buckets, batch=batch)


def read_index(spark: SparkSession, path: str) -> BlockIndex:
    """Stored index; totals and frequencies of appended batches add up."""
    return S.read_blocks(spark, path)


def compact_index(spark: SparkSession, path: str, into: str) -> None:
    """Write all batches of a stored index as one, with full blocks and one vocabulary."""
    S.compact(spark, path, into)


def question_terms(queries: DataFrame, *, stem: bool = False) -> DataFrame:
    """(query_id, term, qtf): a repeated word counts as often as it occurs."""
    return (
        queries.select("query_id", F.explode(query_terms(F.col("query"), stem=stem)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


#: Chunks of a block where query words are too many to broadcast.
BLOCK_CHUNKS = 100_000
#: Chunks that a task scores at once.
PIECE_CHUNKS = 2048


def bm25_topk(
    queries: DataFrame, index: Index | BlockIndex, k: int = 50, *, corpus_version: int | None = None, stats_scope: str = "index",
    version_per_query: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Best ``k`` chunks per query, any word may match: (query_id, chunk_id, score, rank).

    Scores are negative, smaller is better, rounded so that rank does not hang on the order
    of a sum; ties go by chunk id; rank starts at 0.  ``stats_scope="index"`` takes
    frequencies from the whole index even under a snapshot, ``"snapshot"`` from the
    snapshot alone.  With ``version_per_query`` each query row has its own ``as_of`` version.

    A stored index (``read_index``) is asked through its block bounds, see ``block_index``.

    Jobs run here: the size of the query words, and their frequencies (one row per word).
    Postings lie together by chunk and are packed to one row per chunk with the query words in
    it; an unstemmed index packs them inside the row of the chunk (``coded``), analysed once, and
    stores them for its next questions.  A task scores a batch of chunks at a time in dense arrays and carries a running top
    ``k`` per query; a query whose words can gain no more in a batch than its k-th best score so
    far skips the batch.  No (query, chunk) pair becomes a row unless it is among the best ``k``
    of its task.  Query words that fit are broadcast; beyond that blocks of queries meet blocks
    of chunks, scored in the same way.
    """
    if stats_scope not in ("index", "snapshot"):
        raise ValueError("stats_scope must be 'index' or 'snapshot'")
    wanted = question_terms(queries, stem=index.stem)
    within = corpus_version if stats_scope == "snapshot" else None
    if isinstance(index, BlockIndex):
        until = queries.select("query_id", "as_of") if version_per_query else None
        found = S.blocks_topk(wanted, index, k, corpus_version=corpus_version, within=within, as_of=until, broadcast_bytes=broadcast_bytes)
        return ranked(found, k)
    small = fits_broadcast(wanted, broadcast_bytes)
    vocabulary = wanted.select("term").distinct()
    if small and index.texts is not None:
        # Codes take the place of words from here on.
        words, rows = index.coded(sorted(r["term"] for r in vocabulary.collect()))
        matched = as_of(rows, within)
        corpus = matched.filter("dl is not null").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total_len")).first()
        counts = matched.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
        codes = wanted.sparkSession.createDataFrame(pd.DataFrame({"term": words, "code": range(len(words))}), "term string, code int")
        wanted = wanted.join(F.broadcast(codes), "term").select("query_id", F.col("code").alias("term"), "qtf")
        statistics = counts.withColumnRenamed("code", "term")
    else:
        matched = as_of(index.matching(vocabulary, small), within)
        listed = vocabulary.unionByName(vocabulary.limit(1).select(F.lit(ALL_TERMS).alias("term")))
        statistics = reliable_checkpoint(term_statistics(index, matched, within).join(_hinted(listed, small), "term", "left_semi"))
        corpus = statistics.filter(F.col("term") == ALL_TERMS).first()
    n, total_len = (corpus["df"], corpus["total_len"] or 0) if corpus else (0, 0)
    avgdl = max(total_len / n, 1e-9) if n else 1.0
    weights = wanted.join(statistics.select("term", "df"), "term").select(
        "query_id", "term", (F.col("qtf") * inverse_frequency(F.col("df"), n)).alias("weight")
    )
    until = F.lit(None).cast("long").alias("until")
    if version_per_query:
        weights, until = weights.join(queries.select("query_id", "as_of"), "query_id"), F.col("as_of").cast("long").alias("until")
    weights = reliable_checkpoint(weights.select("query_id", "term", "weight", until))
    gain = lambda tf: tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    live = as_of(matched, corpus_version)
    if small and index.texts is not None:
        packed = _merged(live).select("chunk_id", "corpus_version", "terms", F.transform("tfs", gain).alias("gains"))
        packed = _packed(packed, lambda lists: F.flatten(F.collect_list(lists)))
    else:
        packed = _packed(live.select("term", "chunk_id", "corpus_version", gain(F.col("tf")).alias("gain")).withColumnsRenamed({"term": "terms", "gain": "gains"}), F.collect_list)
    return ranked(block_scores(packed, weights, k, broadcast_bytes), k)


def _packed(live: DataFrame, gather: Callable[[str], Column]) -> DataFrame:
    """One row per chunk of rows that lie by chunk."""
    return live.groupBy("chunk_id").agg(F.max("corpus_version").alias("corpus_version"), gather("terms").alias("terms"), gather("gains").alias("gains"))


def _merged(rows: DataFrame) -> DataFrame:
    """Coded chunks by chunk id, (chunk_id, corpus_version, dl, terms, tfs).  Words of rows that repeat a
    chunk are counted together: equal rows by their number, others word by word."""
    key = ["chunk_id", "corpus_version", "dl"]
    equal = rows.filter(F.size("codes") > 0).repartition("chunk_id").groupBy(*key, "codes", "tfs").agg(F.count(F.lit(1)).alias("_n"))
    counts = F.when(F.col("_n") == 1, F.col("tfs")).otherwise(F.transform("tfs", lambda tf: tf * F.col("_n")))
    gathered = equal.groupBy(*key).agg(F.collect_list(F.struct("codes", counts.alias("tfs"))).alias("_p"))
    as_map = lambda part: F.map_from_arrays(part["codes"], part["tfs"])
    both = lambda _, x, y: F.coalesce(x, F.lit(0).cast("long")) + F.coalesce(y, F.lit(0).cast("long"))
    first, rest = F.get("_p", F.lit(0)), F.slice("_p", F.lit(2), F.size("_p"))
    summed = F.aggregate(rest, as_map(first), lambda total, part: F.map_zip_with(total, as_map(part), both))
    alone = F.size("_p") == 1
    return gathered.select(*key, F.when(alone, first["codes"]).otherwise(F.map_keys(summed)).alias("terms"), F.when(alone, first["tfs"]).otherwise(F.map_values(summed)).alias("tfs"))


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


class _Scorer:
    """Dense scores of batches of chunks, with a running best ``k`` per query."""

    def __init__(self, weights: pd.DataFrame, k: int):
        code, self.query_ids = pd.factorize(weights["query_id"])
        order = np.argsort(code, kind="stable")
        term, names = pd.factorize(weights["term"])
        self.k, self.query, self.term, self.weight = k, code[order], term[order], weights["weight"].to_numpy()[order]
        self.terms = pd.Index(names)
        self.first = np.searchsorted(self.query, np.arange(len(self.query_ids) + 1))
        self.until = weights["until"].astype("float64").fillna(np.inf).to_numpy()[order][self.first[:-1]]
        self.floor = np.full(len(self.query_ids), -np.inf)
        self.found = (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object))

    def feed(self, frame: pd.DataFrame) -> None:
        many, words = len(frame), len(self.terms)
        held = frame["terms"].map(len).to_numpy()
        if not held.sum():
            return
        chunk, gain = np.repeat(np.arange(many), held), np.concatenate(frame["gains"].tolist())
        term = self.terms.get_indexer(np.concatenate(frame["terms"].tolist()))
        known = term >= 0
        if not known.any():
            return
        chunk, term, gain = chunk[known], term[known], gain[known]
        order = np.argsort(term, kind="stable")
        chunk, term, gain = chunk[order], term[order], gain[order]
        at = np.searchsorted(term, np.arange(words + 1))
        peak = np.zeros(words)
        np.maximum.at(peak, term, gain)
        reach = np.bincount(self.query, weights=self.weight * peak[self.term], minlength=len(self.query_ids))
        ids, versions, parts = frame["chunk_id"].to_numpy(), frame["corpus_version"].to_numpy(), [self.found]
        for q in np.flatnonzero((reach > 0) & (reach + MARGIN >= self.floor)):
            scores = np.zeros(many)
            for j in range(self.first[q], self.first[q + 1]):
                lo, hi = at[self.term[j]], at[self.term[j] + 1]
                scores[chunk[lo:hi]] += self.weight[j] * gain[lo:hi]
            hit = np.flatnonzero((scores > 0) & (versions <= self.until[q]))
            value = np.round(-scores[hit], SCORE_DIGITS)
            if len(hit) > self.k:
                keep = value <= np.partition(value, self.k - 1)[self.k - 1]
                hit, value = hit[keep], value[keep]
            parts.append((np.full(len(hit), q), value, ids[hit]))
        self.found = _first_k(*(np.concatenate(x) for x in zip(*parts, strict=True)), self.k)
        query, value, _ = self.found
        last = np.flatnonzero(np.bincount(query, minlength=len(self.floor)) == self.k)
        self.floor[last] = -value[np.searchsorted(query, last, side="right") - 1]

    def frame(self) -> pd.DataFrame:
        query, value, ids = self.found
        return pd.DataFrame({"query_id": self.query_ids[query], "chunk_id": ids, "score": value})


def block_scores(packed: DataFrame, weights: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Best ``k`` (query_id, chunk_id, score) per query and task, from ``packed`` chunks (chunk_id,
    corpus_version, terms, gains) and stored ``weights`` (query_id, term, weight, until)."""
    kinds = {f.name: f.dataType.simpleString() for f in [*weights.schema.fields, *packed.schema.fields]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    size = measured_bytes(weights)
    if size <= broadcast_bytes:
        sent = weights.sparkSession.sparkContext.broadcast(weights.toPandas())

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = _Scorer(sent.value, k)
            for frame in pieces(frames, most=PIECE_CHUNKS):
                scorer.feed(frame)
            yield scorer.frame()

        return packed.mapInPandas(scan, schema)
    query_blocks, chunk_blocks = -(-size // max(1, broadcast_bytes)), max(1, -(-packed.count() // BLOCK_CHUNKS))
    left = weights.withColumn("_q", row_hash_salt("query_id", salts=query_blocks)).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(chunk_blocks - 1))))
    right = packed.withColumn("_v", row_hash_salt("chunk_id", salts=chunk_blocks)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def meet(asked: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        scorer = _Scorer(asked, k)
        for piece in pieces(iter([chunks] if len(asked) else []), most=PIECE_CHUNKS):
            scorer.feed(piece)
        return scorer.frame()

    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(meet, schema)


def ranked(scored: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """Top ``k`` per query with a 0-based ``rank``."""
    order = order or [F.col("score").asc(), F.col("chunk_id").asc()]
    top = first_rows(scored, ["query_id"], order, k, "_rn")
    return top.withColumn("rank", (F.col("_rn") - 1).cast("long")).drop("_rn")


def select_all(
    chunks: DataFrame, *, corpus_version: int | None = None, evidence_id: str | None = None, limit: int = 50
) -> DataFrame:
    """Chunks without matching, ordered by (evidence_id, seq), cut at ``limit``, score 0."""
    found = as_of(chunks, corpus_version)
    if evidence_id is not None:
        found = found.filter(F.col("evidence_id") == evidence_id)
    top = found.select("chunk_id", "evidence_id", "seq").orderBy("evidence_id", "seq").limit(limit)
    # At most ``limit`` rows are left here, so one window over them is bounded.
    return first_rows(top.withColumn("_all", F.lit(0)), ["_all"], [F.col("evidence_id"), F.col("seq")], limit, "_rn").select(
        "chunk_id", "evidence_id", "seq", (F.col("_rn") - 1).cast("long").alias("rank"), F.lit(0.0).alias("score")
    )


def select_all_each(requests: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """The same for a table of requests (query_id, evidence_id, as_of): whole passages.

    ``chunks_found`` counts the chunks of a request before any limit.  A caller who sets
    ``limit`` gets the first ones, and ``truncated`` says where some are missing.  Requests are
    salted, since very many may ask for one document."""
    asked = requests.select("evidence_id").distinct()
    held = chunks.select("evidence_id", "chunk_id", "seq", "corpus_version").join(asked, "evidence_id", "left_semi")
    found = salted_join(requests, held, "evidence_id", "inner", ["query_id"]).filter(F.col("as_of").isNull() | (F.col("corpus_version") <= F.col("as_of")))
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_found"))
    placed = found.withColumn("rank", (F.row_number().over(_by_query("seq", "chunk_id")) - 1).cast("long")).join(counts, "query_id")
    if limit is not None:
        placed = placed.filter(F.col("rank") < limit)
    truncated = F.lit(False) if limit is None else F.col("chunks_found") > limit
    return placed.select("query_id", "chunk_id", "evidence_id", F.lit(0.0).alias("score"), "rank", "chunks_found", truncated.alias("truncated"))


# --- nearest neighbours -------------------------------------------------------------------
DISTANCE_DIGITS = 6
#: Distances held at once: queries of a step times vectors of a step.
CELLS = 8_000_000
#: Vectors of a block, and copies of a row that smaller blocks may cost.
BLOCK_ROWS = 100_000
COPIES = 16


class _Nearest:
    """Running best ``k`` per query, ties by chunk id, fed with batches of vectors."""

    def __init__(self, queries: np.ndarray, versions: np.ndarray | None, k: int):
        self.queries, self.versions, self.k = queries, versions, k
        self.squares = (queries**2).sum(1)
        self.edge = np.full(len(queries), np.inf)
        self.found = (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object))

    def feed(self, ids: np.ndarray, vectors: np.ndarray, versions: np.ndarray | None) -> None:
        wide = max(1, min(len(ids), 4096))
        tall = max(1, CELLS // wide)
        for v in range(0, len(ids), wide):
            block, squares = vectors[v : v + wide], (vectors[v : v + wide] ** 2).sum(1)
            parts = [self.found]
            for q in range(0, len(self.queries), tall):
                squared = self.squares[q : q + tall, None] + squares[None, :] - 2.0 * (self.queries[q : q + tall] @ block.T)
                if np.isfinite(edge := self.edge[q : q + tall]).all():
                    # Only what may come before the k-th best so far; a step more than rounding can move it.
                    row, column = np.nonzero(squared <= ((edge + 10.0**-DISTANCE_DIGITS) ** 2)[:, None])
                    if versions is not None and self.versions is not None:
                        seen = versions[v : v + wide][column] <= self.versions[row + q]
                        row, column = row[seen], column[seen]
                    distance = np.round(np.sqrt(np.maximum(squared[row, column], 0.0)), DISTANCE_DIGITS)
                    parts.append((row + q, distance, ids[v : v + wide][column]))
                    continue
                distance = np.round(np.sqrt(np.maximum(squared, 0.0)), DISTANCE_DIGITS)
                if versions is not None and self.versions is not None:
                    distance[versions[None, v : v + wide] > self.versions[q : q + tall, None]] = np.inf
                keep = min(self.k, len(block)) - 1
                edge = np.partition(distance, keep, axis=1)[:, keep]
                row, column = np.nonzero((distance <= edge[:, None]) & np.isfinite(distance))
                parts.append((row + q, distance[row, column], ids[v : v + wide][column]))
            self.found = _first_k(*(np.concatenate(x) for x in zip(*parts, strict=True)), self.k)
            query, value, _ = self.found
            last = np.flatnonzero(np.bincount(query, minlength=len(self.edge)) == self.k)
            self.edge[last] = value[np.searchsorted(query, last, side="right") - 1]

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        query, distance, ids = self.found
        return pd.DataFrame({"query_id": query_ids[query], "chunk_id": ids, "distance": distance})


def _blocks(size: int, wished: int, largest: int) -> int:
    """Number of blocks of about ``wished``.  Each row of the other side is copied to every one of them,
    so where that takes more than ``COPIES`` the blocks grow with the table, up to ``largest``."""
    return max(1, min(-(-size // max(1, wished)), COPIES), -(-size // max(1, wished, largest)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def knn_topk(
    queries: DataFrame, vectors: DataFrame, k: int, *, corpus_version: int | None = None, version_per_query: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact L2 nearest chunks: queries (query_id, embedding) against
    vectors (chunk_id, embedding, corpus_version) → (query_id, chunk_id, distance, rank).

    Ids keep their types.  With ``version_per_query`` each query sees vectors up to its own
    ``as_of`` (NULL: all).  Runs one job to measure the queries.  Small query sets are broadcast
    to tasks over the vectors; larger ones meet the vectors block by block in co-grouped tasks,
    a row being copied 16 times at most while its blocks are smaller than the defaults.
    Either way a task holds at most ``CELLS`` distances at a time and a running top ``k``, and only
    ``k`` rows per query leave it.
    """
    live = as_of(vectors, corpus_version).select("chunk_id", "embedding", F.col("corpus_version").cast("long").alias("_version"))
    until = F.coalesce(F.col("as_of").cast("long"), F.lit(2**62)) if version_per_query else F.lit(2**62)
    queries = queries.select("query_id", "embedding", until.alias("_until"))
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *live.schema.fields]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, distance double"
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if size["n"] == 0:
        return ranked(queries.sparkSession.createDataFrame([], schema), k, [F.col("distance")])

    def ask(best: _Nearest, frame: pd.DataFrame) -> None:
        if len(frame):
            best.feed(frame["chunk_id"].to_numpy(), _matrix(frame["embedding"]), frame["_version"].fillna(0).to_numpy() if version_per_query else None)

    if size["n"] * size["dim"] * 8 <= broadcast_bytes:
        local = queries.toPandas()
        shared = queries.sparkSession.sparkContext.broadcast((local["query_id"].to_numpy(), _matrix(local["embedding"]), local["_until"].to_numpy()))

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, block, versions = shared.value
            best = _Nearest(block, versions, k)
            for frame in frames:
                ask(best, frame)
            yield best.frame(query_ids)

        near = live.mapInPandas(scan, schema)
    else:
        total = live.count()
        query_blocks = _blocks(size["n"] * size["dim"] * 8, broadcast_bytes, BROADCAST_BYTES)
        vector_blocks = _blocks(total, block_rows, BLOCK_ROWS)
        left = queries.withColumn("_q", row_hash_salt("query_id", salts=query_blocks)).withColumn(
            "_v", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1)))
        )
        right = live.withColumn("_v", row_hash_salt("chunk_id", salts=vector_blocks)).withColumn(
            "_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
        )

        def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            best = _Nearest(_matrix(q["embedding"]) if len(q) else np.empty((0, 1)), q["_until"].to_numpy(), k)
            if len(q):
                ask(best, v)
            return best.frame(q["query_id"].to_numpy())

        near = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(meet, schema)
    return ranked(near, k, [F.col("distance").asc(), F.col("chunk_id").asc()])


# --- fusion and hydration -------------------------------------------------------------------
def rrf_fuse(lexical: DataFrame, vector: DataFrame, *, k: int = FUSION_K, limit: int = 50) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, chunk_id, rank[, score]).

    Output: ``fused_score``, the lexical ``score`` (0.0 for vector-only hits) and the new rank.
    """
    lex = lexical.select("query_id", "chunk_id", "rank", "score")
    vec = vector.select("query_id", "chunk_id", "rank", F.lit(0.0).alias("score"))
    share = F.lit(1.0) / (F.col("rank") + k + 1)
    both = lex.withColumn("leg", F.lit(0)).unionByName(vec.withColumn("leg", F.lit(1)))
    fused = both.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(share), 12).alias("fused_score"),
        F.coalesce(F.max(F.when(F.col("leg") == 0, F.col("score"))), F.lit(0.0)).alias("score"),
    )
    return ranked(fused, limit, [F.col("fused_score").desc(), F.col("chunk_id").asc()])


def hydrate(hits: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hits with chunk and evidence columns.  Ids that no longer exist are dropped and
    the remaining hits of a query are ranked again from 0.

    The hits are stored and their distinct ids measured.  Where these are few they are
    broadcast to the scan of the chunks, so that only texts that were hit are moved."""
    hits = reliable_checkpoint(hits)
    ids = hits.select("chunk_id").distinct()
    wanted = chunks.select("chunk_id", "evidence_id", "seq", "text", "headings_path", "token_count").join(_hinted(ids, fits_broadcast(ids)), "chunk_id", "left_semi")
    kept = salted_join(hits, wanted, "chunk_id", "inner", ["query_id"])
    titled = evidence.select(
        "evidence_id", F.col("title").alias("evidence_title"), F.col("source_path").alias("evidence_source_path")
    )
    return rerank(kept.join(titled, "evidence_id"))


def rerank(hits: DataFrame) -> DataFrame:
    """Close the gaps in ``rank``; a query holds at most the top-k rows it asked for."""
    window = F.row_number().over(_by_query("rank", "chunk_id"))
    return hits.withColumn("rank", (window - 1).cast("long"))


def _by_query(*order: str):
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(*order)


@dataclass(frozen=True)
class Corpus:
    """What a retrieval needs: chunks and evidence, an index, and optionally vectors with
    the model that made them."""

    chunks: DataFrame
    evidence: DataFrame
    index: Index
    vectors: DataFrame | None = None
    embedding_model: str | None = None
    embed_fn: EmbedFn | None = None


def embed_queries(queries: DataFrame, embed_fn: EmbedFn, batch: int = 64) -> DataFrame:
    """(query_id, embedding) of query texts, ``batch`` texts per call of the plugged-in model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["query"].tolist()
            made = [v for at in range(0, len(texts), batch) for v in embed_fn(texts[at : at + batch])]
            yield pd.DataFrame({"query_id": frame["query_id"], "embedding": made})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query").mapInPandas(run, f"query_id {kind}, embedding array<double>")


def retrieve(
    queries: DataFrame, corpus: Corpus, *, limit: int = 50, corpus_version: int | None = None,
    query_vectors: DataFrame | None = None, version_per_query: bool = False,
) -> DataFrame:
    """Hits per query with the method used and the number of candidates considered.

    Without a model the list is BM25.  With a model but no vectors it falls back to BM25
    and ``fallback`` says so.  Otherwise both lists are fused; query vectors come from
    ``query_vectors`` or the corpus's ``embed_fn``.  With ``version_per_query`` both lists keep
    to each query's own ``as_of``.  ``candidates_considered`` counts the BM25 rows after the
    limit, or the distinct chunks of both lists.  Both lists are stored: each is read twice.
    """
    lexical = reliable_checkpoint(bm25_topk(queries, corpus.index, limit, corpus_version=corpus_version, version_per_query=version_per_query))
    if query_vectors is None and corpus.embed_fn is not None and corpus.vectors is not None:
        query_vectors = reliable_checkpoint(embed_queries(queries, corpus.embed_fn))
    hybrid = corpus.embedding_model is not None and corpus.vectors is not None and query_vectors is not None
    if hybrid:
        if version_per_query:
            query_vectors = query_vectors.select("query_id", "embedding").join(queries.select("query_id", "as_of"), "query_id")
        near = knn_topk(query_vectors, corpus.vectors, limit, corpus_version=corpus_version, version_per_query=version_per_query)
        near = near.select(F.col("query_id"), "chunk_id", "rank")
        alive = reliable_checkpoint(rerank(near.join(corpus.chunks.select("chunk_id"), "chunk_id", "left_semi")))
        both = lexical.select("query_id", "chunk_id").unionByName(alive.select("query_id", "chunk_id")).distinct()
        hits = rrf_fuse(lexical, alive, limit=limit).drop("fused_score")
        considered = both.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates_considered"))
    else:
        hits = lexical
        considered = lexical.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates_considered"))
    return hits.join(considered, "query_id").select(
        "query_id", "chunk_id", "rank", "score",
        F.lit("hybrid_rrf" if hybrid else "bm25").alias("method"),
        F.lit(corpus.embedding_model is not None and not hybrid).alias("fallback"),
        "candidates_considered",
    )


def search_evidence(queries: DataFrame, corpus: Corpus, k: int = 10, **options) -> DataFrame:
    """Top ``k`` chunks per query with everything a reader needs."""
    hits = retrieve(queries, corpus, limit=k, **options)
    return hydrate(hits, corpus.chunks, corpus.evidence)
