"""From documents to deduplicated, versioned evidence and its chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchspark.functions.ids import stable_id
from vouchspark.functions.text import BLANKS, PIECE_PATTERN, first_title
from vouchspark.operators.scaling import global_positions, salted_join
from vouchspark.sources.stored import read_or_empty
from vouchspark.schemas import INT, STRING, table

TARGET_TOKENS, OVERLAP_TOKENS = 800, 100

SECTION = T.ArrayType(table(("start", INT), ("headings_path", STRING), ("body", STRING)))
CHUNK_PARTS = T.ArrayType(table(("text", STRING), ("token_count", INT), ("headings_path", STRING), ("start_offset", INT)))


def with_sha256(df: DataFrame, content: str = "text") -> DataFrame:
    """SHA-256 of the raw bytes, in hex."""
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def new_evidence(batch: DataFrame, evidence: DataFrame | None = None, *, order: str = "doc_id") -> DataFrame:
    """Rows of ``batch`` whose content is new: not in ``evidence``, and the first in
    ``order`` (a unique column) among equal contents.

    Copies are reduced to one key before any shuffle, so a content that makes up a third
    of the batch costs no more than a rare one; the wide rows are then picked by a
    semi join on the unique (content, order) pair.  These pairs grow with the batch, so they are
    hashed per partition and not sent through the driver, and wide rows are not sorted.  Rows
    without content have no hash and are not evidence; ``quarantined`` returns them.
    """
    hashed = batch if "sha256" in batch.columns else with_sha256(batch)
    first = hashed.groupBy("sha256").agg(F.min(order).alias(order))
    if evidence is not None:
        first = first.join(evidence.select("sha256"), "sha256", "left_anti")
    return hashed.join(first.hint("shuffle_hash"), ["sha256", order], "left_semi")


def quarantined(batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` that ``new_evidence`` cannot take: those with a NULL text, or a NULL
    ``sha256`` where the batch brings its own.  Copies are all returned."""
    hashed = batch if "sha256" in batch.columns else with_sha256(batch)
    return hashed.filter(F.col("sha256").isNull()).select(*batch.columns)


def with_evidence_id(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence_id", F.upper(F.substring("sha256", 1, 26)))


def stamp_versions(new: DataFrame, start: int = 0, *, order: str = "doc_id") -> DataFrame:
    """Every new document raises the corpus version by one, in ingest order.  Only the
    order column is numbered; the wide rows then join their number by that unique key."""
    numbers = global_positions(new.select(order), [order], "corpus_version", start)
    # The narrow side is hashed per partition, so the wide rows are neither sorted nor broadcast.
    return new.join(numbers.hint("shuffle_hash"), order)


def with_title(df: DataFrame, fallback: Column, text: str = "text") -> DataFrame:
    return df.withColumn("title", first_title(F.col(text), fallback))


# --- sections and chunks ----------------------------------------------------------------
# Characters that end a line of a document.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
#: What matters at the start of a line: a fence, or up to six marks, a blank and more.
MARK = re.compile(rf"(?:\A|(?<=[{LINE_ENDS}]))(?:[^\S{LINE_ENDS}]*(?P<fence>```|~~~)|(?P<depth>#{{1,6}})(?P<title>[^\S{LINE_ENDS}][^{LINE_ENDS}]+))")
DEPTHS = 6


def _sections(body: str) -> list[tuple[int, str | None, str]]:
    """(start, path, body) of each heading section of one document.

    All marks are found by one scan.  A heading counts where the number of fences before it is
    even.  For every depth the latest heading up to a place is a running maximum; it is part of
    the path there unless a heading of a smaller depth came later.
    """
    marks = list(MARK.finditer(body))
    fences = np.array([m["fence"] is not None for m in marks], dtype=bool)
    heads = [m for m, is_fence, open_ in zip(marks, fences, np.cumsum(fences) % 2, strict=True) if not is_fence and not open_]
    depth = np.array([len(m["depth"]) for m in heads], dtype=np.int64)
    titles = [m["title"].strip() for m in heads]
    number = np.arange(len(heads))
    latest = np.full((DEPTHS + 1, len(heads)), -1)
    for d in range(1, DEPTHS + 1):
        latest[d] = np.maximum.accumulate(np.where(depth == d, number, -1)) if heads else latest[d]
    # The place itself ends everything as deep as it or deeper.
    outer = np.maximum.accumulate(latest, axis=0)
    valid = (latest[1:] >= 0) & (latest[1:] > outer[:-1])
    paths = [" > ".join(titles[latest[d, i]] for d in range(1, DEPTHS + 1) if valid[d - 1, i] and titles[latest[d, i]]) or None for i in number]
    starts = [0, *[m.start() for m in heads]]
    stops = [*starts[1:], len(body)]
    parts = zip(starts, [None, *paths], stops, strict=True)
    return [(lo, path, body[lo:hi]) for lo, path, hi in parts if body[lo:hi].strip()]


@F.pandas_udf(SECTION)
def _sections_udf(bodies: pd.Series) -> pd.Series:
    def rows(body):
        if body is None:
            return None
        return [{"start": s, "headings_path": p, "body": b} for s, p, b in _sections(body)]

    return bodies.map(rows)


def sections(text: Column) -> Column:
    """Heading sections of a text.  Only texts holding a ``#`` reach Python; all others are
    one section, and the Arrow batch carries NULL for them."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(None).cast("string").alias("headings_path"), text.alias("body")))
    has_text = F.regexp_replace(text, rf"{BLANKS}+", "") != ""
    plain = F.when(has_text, whole).otherwise(F.lit(None))
    marked = _sections_udf(F.when(F.contains(text, F.lit("#")), text))
    return F.coalesce(marked, plain.cast(SECTION))


def split_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per section: ``section_start``, ``section_end``, ``headings_path``, ``body``."""
    kept = [c for c in df.columns if c != text]
    exploded = df.select(*kept, F.posexplode(sections(F.col(text))).alias("section_no", "_s"))
    return exploded.select(
        *kept,
        "section_no",
        F.col("_s.start").alias("section_start"),
        (F.col("_s.start") + F.length("_s.body")).alias("section_end"),
        F.col("_s.headings_path").alias("headings_path"),
        F.col("_s.body").alias("body"),
    )


def check_window(target: int, overlap: int) -> int:
    """Step of the token window; rejects impossible arguments."""
    if target <= 0:
        raise ValueError("target must be > 0")
    if not 0 <= overlap < target:
        raise ValueError("overlap must be in [0, target)")
    return max(1, target - overlap)


def count_tokens(col: Column) -> Column:
    return F.size(F.regexp_extract_all(col, F.lit(PIECE_PATTERN), F.lit(0)))


def _word_windows(section: Column, target: int, overlap: int) -> Column:
    """Chunks of one section over its words: every piece keeps the blanks after it, so a
    window is an exact slice of the body."""
    step = check_window(target, overlap)
    body, blanks = section["body"], F.lit(" \t\r\n\f")
    lead = F.length(body) - F.length(F.ltrim(body, blanks))

    def windows(pieces: Column) -> Column:
        n = F.size(pieces)
        last = F.when(n <= target, F.lit(0)).otherwise(F.ceil((n - target) / F.lit(step)).cast("int"))

        def cut(skipped: Column) -> Column:
            """``skipped`` holds the length of each step of words, so that an offset is a sum of
            one number per earlier window, and no earlier word is touched again."""

            def one(i: Column) -> Column:
                text = F.rtrim(F.array_join(F.slice(pieces, i * step + 1, F.lit(target)), ""), blanks)
                offset = F.aggregate(F.slice(skipped, F.lit(1), i), F.lit(0), lambda total, length: total + length)
                return F.struct(
                    text.alias("text"),
                    F.least(F.lit(target), n - i * step).alias("token_count"),
                    section["headings_path"].alias("headings_path"),
                    (section["start"] + lead + offset).alias("start_offset"),
                )

            return F.transform(F.sequence(F.lit(0), last), one)

        steps = F.transform(F.sequence(F.lit(0), last), lambda i: F.length(F.array_join(F.slice(pieces, i * step + 1, F.lit(step)), "")))
        return F.when(n > 0, F.flatten(F.transform(F.array(steps), cut))).otherwise(F.array().cast(CHUNK_PARTS))

    bound = F.array(F.regexp_extract_all(body, F.lit(PIECE_PATTERN), F.lit(0)))
    return F.flatten(F.transform(bound, windows))


#: Blanks between pieces, the longest run of a piece, and the first ideograph or kana.
_BLANK_POINTS, _RUN, _FIRST_IDEOGRAPH = np.array([9, 10, 12, 13, 32], dtype=np.uint32), 64, 0x2E80


def _piece_starts(body: str) -> np.ndarray | None:
    """Where the pieces of ``PIECE_PATTERN`` start in a text; None for one that may hold ideographs."""
    points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) and points.max() >= _FIRST_IDEOGRAPH:
        return None
    word = ~np.isin(points, _BLANK_POINTS)
    at = np.arange(len(points))
    first = word & ~np.concatenate([[False], word[:-1]])[: len(word)]
    run = np.maximum.accumulate(np.where(first, at, 0)) if len(at) else at
    return np.flatnonzero(word & ((at - run) % _RUN == 0))


#: The same blanks among bytes of UTF-8.
_BLANK_BYTES = np.isin(np.arange(256), _BLANK_POINTS)
_PARTS = pa.struct([("text", pa.string()), ("token_count", pa.int32()), ("headings_path", pa.string()), ("start_offset", pa.int32())])


def _byte_pieces(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Pieces of ``PIECE_PATTERN`` in a batch of texts, found on their bytes: (data, edges of the texts,
    start and end of every piece, number of the characters before each byte, whether a text may hold
    ideographs, whether it has a run of other characters that is too long to tell characters from bytes)."""
    texts = texts.cast(pa.large_string())
    _, edges, data = texts.buffers()
    edges = np.frombuffer(edges, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, edges = np.frombuffer(data or b"", dtype=np.uint8)[edges[0] : edges[-1]], edges - edges[0]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    # A character from U+2E80 on starts with E2 and a byte from BA on, or with E3 or more.
    far = np.flatnonzero((data >= 0xE3) | ((data == 0xE2) & (np.append(data[1:], 0)[: len(data)] >= 0xBA)))
    word = np.concatenate([[False], ~_BLANK_BYTES[data], [False]])
    inner = edges[1:-1]
    turns = word[1:] != word[:-1]
    starts, ends = np.flatnonzero(turns & word[1:]), np.flatnonzero(turns & word[:-1])
    # A run that goes on over the edge of a text is one run in each.
    joint = np.unique(inner[(inner > 0) & (inner < len(data)) & word[inner] & word[np.minimum(inner + 1, len(word) - 1)]])
    starts, ends = np.sort(np.concatenate([starts, joint])), np.sort(np.concatenate([ends, joint]))
    row = lambda at: np.searchsorted(edges, at, side="right") - 1
    odd, long = (np.bincount(row(x), minlength=len(texts)).astype(bool) for x in (far, starts[ends - starts > _RUN]))
    long &= chars[edges[1:]] - chars[edges[:-1]] < edges[1:] - edges[:-1]
    # Runs of ASCII are cut after every 64 characters.
    many = -(-(ends - starts) // _RUN)
    if len(many) and many.max() > 1:
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts, last = np.repeat(starts, many) + nth * _RUN, np.repeat(ends, many)
        ends = np.minimum(starts + _RUN, last)
    return data, edges, starts, ends, chars, odd, long


def _plain_windows(target: int, overlap: int):
    """The chunks of ``_word_windows`` for whole texts, found in one pass over the bytes of a batch; NULL
    for texts that may hold ideographs."""
    step = check_window(target, overlap)

    def slow(body: str) -> list[tuple[int, int, int]]:
        starts = _piece_starts(body)
        n, edges = len(starts), [*starts.tolist(), len(body)]
        many = 1 + -(-max(0, n - target) // step) if n else 0
        return [(edges[lo], edges[min(lo + target, n)], min(target, n - lo)) for lo in range(0, many * step, step)]

    @F.arrow_udf(CHUNK_PARTS)
    def cut(bodies: pa.Array) -> pa.Array:
        data, edges, starts, ends, chars, odd, long = _byte_pieces(bodies)
        none = odd | bodies.is_null().to_numpy(zero_copy_only=False)
        base = np.searchsorted(starts, edges)
        n = np.where(none | long, 0, np.diff(base))
        many = np.where(n > 0, 1 + -(-np.maximum(n - target, 0) // step), 0)
        row = np.repeat(np.arange(len(bodies)), many)
        lo = base[row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * step
        hi = np.minimum(lo + target, base[row] + n[row])
        first, stop, raw = starts[lo], ends[hi - 1], data.tobytes()
        texts = [raw[x:y] for x, y in zip(first.tolist(), stop.tolist(), strict=True)]
        counts, offsets = hi - lo, chars[first] - chars[edges[row]]
        if (left := np.flatnonzero(long & ~none)).size:
            # Their windows are put between those of the other texts.
            at = np.cumsum(many) - many
            more = [(i, *w, bodies[i].as_py()) for i in left.tolist() for w in slow(bodies[i].as_py())]
            places = [at[m[0]] for m in more]
            for place, (_, x, y, _, body) in reversed(list(zip(places, more, strict=True))):
                texts.insert(place, body[x:y].rstrip(" \t\r\n\f").encode())
            counts, offsets = np.insert(counts, places, [m[3] for m in more]), np.insert(offsets, places, [m[1] for m in more])
            many = many + np.bincount([m[0] for m in more], minlength=len(many))
        parts = pa.StructArray.from_arrays(
            [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int32)), pa.nulls(len(texts), pa.string()), pa.array(offsets.astype(np.int32))],
            fields=list(_PARTS),
        )
        places = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), mask=np.append(none, False))
        return pa.ListArray.from_arrays(places, parts)

    return cut


Tokenizer = Callable[[str], list[tuple[int, int]]]


_TRIMMED = re.compile(r"\S(?:.*\S)?", re.DOTALL)


def _span_windows(body: str, spans: list[tuple[int, int]], target: int, step: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, token count) of each non-blank window over token spans, without outer blanks.
    A window reaches to the token behind it, the last one to the end of the body."""
    many = len(spans)
    if not many:
        return
    borders = np.array([*[start for start, _ in spans], len(body)])
    firsts = np.arange(0, max(1, many - target + step), step)
    firsts = firsts[firsts < many]
    lasts = np.minimum(firsts + target, many)
    for lo, hi, count in zip(borders[firsts].tolist(), borders[lasts].tolist(), (lasts - firsts).tolist(), strict=True):
        found = _TRIMMED.search(body, lo, hi)
        if found:
            yield *found.span(), count


def _tokenizer_windows(tokenizer: Tokenizer, target: int, overlap: int):
    """Chunks of all sections by a plugged-in tokenizer that maps a text to its token
    spans (character offsets, in order)."""
    step = check_window(target, overlap)

    @F.pandas_udf(CHUNK_PARTS)
    def cut(column: pd.Series) -> pd.Series:
        def chunks(parts):
            out = []
            for part in parts if parts is not None else []:
                body, base = part["body"], part["start"]
                spans = tokenizer(body)
                for lo, hi, n in _span_windows(body, spans, target, step):
                    out.append({"text": body[lo:hi], "token_count": n, "headings_path": part["headings_path"],
                                "start_offset": base + lo})
            return out

        return column.map(chunks)

    return cut


def chunk_documents(
    df: DataFrame, *, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, tokenizer: Tokenizer | None = None,
    headings: bool = True,
) -> DataFrame:
    """Token-window chunks of every document, numbered from 0 across its sections.

    Sections and windows are built inside the row and then exploded, so there is no
    shuffle and ``seq`` needs no window.  Input: ``evidence_id``, ``sha256``, ``text`` and
    any columns to carry along; ``body[start_offset:end_offset]`` is the chunk text.
    """
    check_window(target, overlap)
    text = F.col("text")
    if headings:
        parts = sections(text)
    else:
        one = F.struct(F.lit(0).alias("start"), F.lit(None).cast("string").alias("headings_path"), text.alias("body"))
        parts = F.array(one)
    if tokenizer is not None:
        chunks = _tokenizer_windows(tokenizer, target, overlap)(parts)
    else:
        chunks = F.flatten(F.transform(parts, lambda s: _word_windows(s, target, overlap)))
        if not headings:
            # Only texts that may hold ideographs are left to the pattern.
            chunks = F.coalesce(_plain_windows(target, overlap)(text), chunks)
    kept = [c for c in df.columns if c not in ("text", "title")]
    exploded = df.select(*kept, F.posexplode(chunks).alias("seq", "_c"))
    return exploded.select(
        stable_id(F.col("sha256"), F.col("seq").cast("string")).alias("chunk_id"),
        *kept,
        "seq",
        *[F.col(f"_c.{name}").alias(name) for name in ("text", "token_count", "headings_path", "start_offset")],
        (F.col("_c.start_offset") + F.length("_c.text")).alias("end_offset"),
    )


# --- snapshots, vectors, catalogue --------------------------------------------------------
def as_of(df: DataFrame, version: int | None) -> DataFrame:
    """Rows known at a corpus version; a plain filter that reaches the parquet scan."""
    return df if version is None else df.filter(F.col("corpus_version") <= version)


def missing_embeddings(chunks: DataFrame, evidence: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector, carrying the version their evidence was ingested at."""
    lacking = chunks.select("chunk_id", "evidence_id", "text").join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    versions = evidence.select("evidence_id", "corpus_version")
    joined = salted_join(lacking, versions, "evidence_id", "inner", ["chunk_id"])
    return joined.select("chunk_id", "evidence_id", "corpus_version", "text")


EmbedFn = Callable[[list[str]], list[list[float]]]


def embed_chunks(missing: DataFrame, embed_fn: EmbedFn, batch: int = 64) -> DataFrame:
    """Vectors for chunk texts, ``batch`` texts per call of the plugged-in model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            vectors: list[list[float]] = []
            for at in range(0, len(texts), batch):
                vectors.extend(embed_fn(texts[at : at + batch]))
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "corpus_version": frame["corpus_version"], "embedding": vectors})

    return missing.select("chunk_id", "corpus_version", "text").mapInPandas(
        run, "chunk_id string, corpus_version long, embedding array<float>"
    )


def backfill(chunks: DataFrame, evidence: DataFrame, vectors_path: str, embed_fn: EmbedFn, batch: int = 64) -> None:
    """Append vectors for chunks that have none.  A path that does not exist yet is an empty
    table; a second run finds nothing to do."""
    spark = chunks.sparkSession
    schema = "chunk_id string, corpus_version long, embedding array<float>"
    vectors = read_or_empty(spark, vectors_path, schema)
    embed_chunks(missing_embeddings(chunks, evidence, vectors), embed_fn, batch).write.mode("append").parquet(vectors_path)


def vector_dims(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """One row: smallest and largest dimension, vector count, and whether the table keeps
    the one-dimension contract (``dim`` if given)."""
    found = vectors.agg(
        F.min(F.size("embedding")).cast("long").alias("min_dim"),
        F.max(F.size("embedding")).cast("long").alias("max_dim"),
        F.count(F.lit(1)).alias("vectors"),
    )
    agrees = F.col("min_dim") == F.col("max_dim")
    if dim is not None:
        agrees = agrees & (F.col("max_dim") == dim)
    return found.withColumn("consistent", F.coalesce(agrees, F.lit(True)))


def assert_dim(vectors: DataFrame, dim: int) -> DataFrame:
    """The same table; a vector of another size fails the job that reads it."""
    fits = F.assert_true(F.size("embedding") == dim, F.lit(f"embedding dimension is not {dim}"))
    return vectors.filter(fits.isNull())


NAME_PATTERN = r"^[\p{L}\p{N}_-]{1,64}\z"


def valid_workspace(name: Column) -> Column:
    return F.coalesce(F.rlike(name, F.lit(NAME_PATTERN)), F.lit(False))


def catalogue(evidence: DataFrame, chunks: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Per workspace: corpus version, document and chunk counts, embedding model."""
    documents = evidence.groupBy("workspace").agg(
        F.max("corpus_version").alias("corpus_version"), F.count(F.lit(1)).alias("documents")
    )
    pieces = chunks.groupBy("workspace").agg(F.count(F.lit(1)).alias("chunks"))
    out = documents.join(pieces, "workspace", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    if models is not None:
        out = out.join(models.select("workspace", "embedding_model"), "workspace", "left")
    return out.filter(valid_workspace(F.col("workspace")))


def renumber(chunks: DataFrame) -> DataFrame:
    """``seq`` recomputed from the start offsets, for chunks cut section by section
    elsewhere.  Places are counted over the whole table and the first place of each
    document is taken off, so a document with very many chunks needs no window of its own."""
    order = ["evidence_id", "start_offset", "end_offset"]
    placed = global_positions(chunks.drop("seq"), order, "_at")
    first = placed.groupBy("evidence_id").agg(F.min("_at").alias("_first"))
    joined = salted_join(placed, first, "evidence_id", "inner", ["_at"])
    return joined.withColumn("seq", F.col("_at") - F.col("_first")).drop("_at", "_first")
