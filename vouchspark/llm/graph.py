"""Connected components of a list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node it reaches) of every node of ``links``,
    whose first two columns are the ends.

    Alternates two steps until nothing changes: every node ties its larger neighbours to its
    smallest neighbour, then its smaller ones.  The number of rounds grows with the logarithm of
    the longest path.  A node with very many links is a partial minimum in every task and the
    many side of a join with one row per key.  Every round is stored; links of a node with
    itself are dropped.
    """
    a, b = (F.col(c).cast("long") for c in links.columns[:2])
    down = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    down, before = stored(down, "links"), None
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = stored(small.distinct(), "links")
        now = tuple(down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = down.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
