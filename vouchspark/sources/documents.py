"""Tables as evidence: documents, and fetched web pages with their admission rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchspark.sources.files import PDF_MIME, TEXT_MIMES

MAX_PAGE_BYTES = 25 * 1024 * 1024
# Address blocks that are not public (IANA special-purpose registries).
NON_PUBLIC_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
# Global unicast IPv6 starts with 2 or 3; these blocks inside it are still special.
NON_PUBLIC_V6 = r"^(?![23])|^2001:(0*[01]?[0-9a-f]{0,2}:|0*db8:|:)|^2002:|^3fff:0"


def from_documents(df: DataFrame, *, id: str, text: str, source: str) -> DataFrame:
    """A table of texts in evidence form: doc_id, text, source_path, mime_type."""
    return df.select(
        F.col(id).alias("doc_id"),
        F.col(text).alias("text"),
        F.concat_ws("/", F.col(source), F.col(id).cast("string")).alias("source_path"),
        F.lit("text/plain").alias("mime_type"),
    )


def _block(cidr: str) -> tuple[int, int]:
    address, bits = cidr.split("/")
    low = int.from_bytes(bytes(int(part) for part in address.split(".")))
    return low, low + (1 << (32 - int(bits))) - 1


def url_host(url: Column) -> tuple[Column, Column, Column]:
    """(scheme, authority, host); an IPv6 host is given without its brackets."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    bracketed = F.regexp_extract(place, r"^\[([^\]]*)\]", 1)
    host = F.when(F.startswith(place, F.lit("[")), bracketed).otherwise(F.regexp_extract(place, r"^([^:]*)", 1))
    return scheme, authority, F.lower(host)


def literal_non_public(host: Column) -> Column:
    """Whether the host is an address literal outside the public ranges.  Names are not
    resolved: a name is judged where it is fetched."""
    is_v4 = F.rlike(host, F.lit(r"^\d{1,3}(\.\d{1,3}){3}\z"))
    octets = F.transform(F.split(host, r"\."), lambda p: F.try_to_number(p, F.lit("999")).cast("long"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, octet: acc * 256 + octet)
    hit = reduce(lambda a, b: a | b, [value.between(*_block(c)) for c in NON_PUBLIC_V4])
    is_v6 = F.contains(host, F.lit(":"))
    return F.when(is_v4, hit).when(is_v6, F.rlike(host, F.lit(NON_PUBLIC_V6))).otherwise(F.lit(False))


def admit_pages(df: DataFrame, *, url: str = "url", body: str = "body", mime: str = "mime_type") -> DataFrame:
    """``admitted`` and the first ``reason`` against a fetched page."""
    scheme, authority, host = url_host(F.col(url))
    media = F.trim(F.element_at(F.split(F.col(mime), ";"), 1))
    supported = F.startswith(media, F.lit("text/")) | media.isin(*TEXT_MIMES, PDF_MIME)
    reason = (
        F.when(~scheme.isin("http", "https"), "scheme")
        .when(F.contains(authority, F.lit("@")), "credentials")
        .when(host == "", "no host")
        .when(literal_non_public(host), "non-public address")
        .when(F.octet_length(F.col(body)) > MAX_PAGE_BYTES, "too large")
        .when(~supported, "unsupported type")
    )
    return df.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())
