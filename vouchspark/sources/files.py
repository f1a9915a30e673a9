"""File corpora: which files count, what they are, and their text."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchspark.sources.corpus_source import read_corpus

# Folders never read, and the non-text types that are still read.
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "venv", ".pytest_cache")
TEXT_MIMES = ("text/markdown", "text/x-markdown", "text/plain", "text/html", "text/x-rst", "application/json")
PDF_MIME = "application/pdf"
UNKNOWN_MIME = "application/octet-stream"


def _mime_table() -> dict[str, str]:
    """Extension → type: Python's built-in registry plus the extra text extensions."""
    extra = {
        ".md": "text/markdown", ".markdown": "text/markdown", ".mdown": "text/markdown", ".txt": "text/plain",
        ".text": "text/plain", ".rst": "text/x-rst", ".json": "application/json",
    }
    return {**extra, **mimetypes.MimeTypes(filenames=()).types_map[True]}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*\z", "")


def mime_type(path: Column) -> Column:
    """Type by extension; a compression suffix is looked through."""
    pairs = [F.lit(x) for item in sorted(_mime_table().items()) for x in item]
    bare = F.regexp_replace(file_name(path), r"\.(gz|Z|bz2|xz|br)\z", "")
    extension = F.lower(F.regexp_extract(bare, r".(\.[^.]+)\z", 1))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), F.lit(UNKNOWN_MIME))


def admitted_mime(mime: Column) -> Column:
    return F.startswith(mime, F.lit("text/")) | mime.isin(*TEXT_MIMES, PDF_MIME)


def with_mime(df: DataFrame, path: str = "path") -> DataFrame:
    """``mime_type`` and ``admitted``; a file that is not admitted stays as a quarantine row."""
    typed = df.withColumn("mime_type", mime_type(F.col(path)))
    return typed.withColumn("admitted", admitted_mime(F.col("mime_type")))


def decode_text(content: Column) -> Column:
    """UTF-8 text; broken bytes become U+FFFD instead of failing the job."""
    return F.make_valid_utf8(content.cast("string"))


def inside(path: Column, root: str) -> Column:
    """Path below the scanned root, whatever scheme prefix the listing adds."""
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/*(?=/)", "")
    clean = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.substr(bare, F.lit(len(clean) + 2))


def kept_path(relative: Column) -> Column:
    parts = F.split(relative, "/")
    return ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*SKIPPED_FOLDERS))


def scan_corpus(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files below ``path`` as (path, relative, content, mime_type, admitted, text).

    Hidden and tool folders are not entered, at any depth, and files of other types are listed
    with NULL content, not opened.  PDF content is admitted with NULL text: extracting it is
    left to a plug-in.
    """
    readable = F.col("admitted") & (F.col("mime_type") != PDF_MIME)
    return read_corpus(spark, path, recursive).withColumn("text", F.when(readable, decode_text(F.col("content"))))


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """One file; an unsupported type fails the job instead of being set aside."""
    typed = with_mime(spark.read.format("binaryFile").load(path).select("path", "content"))
    supported = F.assert_true(F.col("admitted"), F.concat(F.lit("unsupported file type: "), F.col("mime_type")))
    return typed.filter(supported.isNull()).withColumn("text", decode_text(F.col("content")))
