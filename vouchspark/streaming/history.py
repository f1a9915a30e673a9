"""History of content hashes, read only where a batch may hit it, and compaction of grown tables.

Hashes lie in folders by bucket (a prefix of the hash), and every bucket of a batch has a Bloom
filter, kept as rows (bucket, word, bits) so that filters are built and asked with plain
aggregates and joins.  A new batch asks the filters first; only buckets in which some hash may have
occurred before are read.  A filter errs to one side: what it does not know is new for sure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchspark.operators.scaling import fits_broadcast
from vouchspark.session import reliable_checkpoint
from vouchspark.streaming.tables import read_table, write_batch

HASHES = "sha256 string, bucket int"
FILTERS = "bucket int, word int, bits long"
VERSIONS = "last_version long"
BUCKETS = 256
#: Bits of the filter of a bucket, and bits that a hash sets there.
FILTER_BITS, PROBES = 1 << 20, 4


def bucket_of(sha256: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.conv(F.substring(sha256, 1, 6), 16, 10).cast("int"), F.lit(buckets)).cast("int")


def probes(sha256: Column, bits: int = FILTER_BITS) -> Column:
    """Places of a hash in its filter, from other digits than the bucket's."""
    return F.array(*[F.pmod(F.conv(F.substring(sha256, 9 + 8 * i, 8), 16, 10).cast("long"), F.lit(bits)) for i in range(PROBES)])


def _probed(hashes: DataFrame) -> DataFrame:
    at = hashes.select("sha256", "bucket", F.explode(F.array_distinct(probes(F.col("sha256")))).alias("at"))
    return at.select("sha256", "bucket", F.shiftright("at", 6).cast("int").alias("word"), F.col("at").bitwiseAND(63).cast("int").alias("bit"))


def filter_words(hashes: DataFrame) -> DataFrame:
    """Bloom filters of ``hashes`` (sha256, bucket): the words of 64 bits that are not 0."""
    one = F.expr("shiftleft(1L, bit)")
    return _probed(hashes).groupBy("bucket", "word").agg(F.bit_or(one).alias("bits"))


def may_occur(hashes: DataFrame, filters: DataFrame) -> DataFrame:
    """Hashes all of whose bits are set in the filters."""
    known = filters.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    asked = _probed(hashes)
    met = asked.join(known, ["bucket", "word"], "left").withColumn("set", F.expr("coalesce(getbit(bits, bit), 0) = 1"))
    return met.groupBy("sha256", "bucket").agg(F.bool_and("set").alias("all")).filter("all").select("sha256", "bucket")


def known_hashes(spark: SparkSession, root: str, hashes: DataFrame, before: int, buckets: int = BUCKETS) -> DataFrame:
    """Those of ``hashes`` (distinct ``sha256``) that an earlier batch has.  Reads the filters, and of the
    hashes only the folders of buckets that the filters cannot rule out: at most ``buckets``
    numbers come to the driver."""
    listed = hashes.select("sha256").filter(F.col("sha256").isNotNull()).distinct().withColumn("bucket", bucket_of(F.col("sha256"), buckets))
    maybe = reliable_checkpoint(may_occur(listed, read_table(spark, root, "filters", FILTERS, before=before)))
    needed = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
    if not needed:
        return maybe.select("sha256")
    held = read_table(spark, root, "hashes", HASHES, before=before).filter(F.col("bucket").isin(needed))
    return held.join(F.broadcast(maybe.select("sha256")) if fits_broadcast(maybe) else maybe.select("sha256"), "sha256", "left_semi").select("sha256").distinct()


def remember(new: DataFrame, root: str, number: int, buckets: int = BUCKETS) -> None:
    """Append the hashes of one batch (``sha256``, ``corpus_version``) with their filters and last version."""
    hashes = new.select("sha256").withColumn("bucket", bucket_of(F.col("sha256"), buckets))
    write_batch(hashes.repartition("bucket"), root, "hashes", number, partition_by=["bucket"])
    write_batch(filter_words(hashes), root, "filters", number)
    write_batch(new.agg(F.max("corpus_version").alias("last_version")), root, "versions", number)


def last_version(spark: SparkSession, root: str, before: int) -> int:
    """Highest version before a batch, from one number per batch."""
    return read_table(spark, root, "versions", VERSIONS, before=before).agg(F.max("last_version")).first()[0] or 0
