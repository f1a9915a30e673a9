"""Helpers that keep plans safe when keys are skewed or inputs grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchspark.session import reliable_checkpoint

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` in bytes, by one aggregate job: text by its length, arrays of
    numbers by their size, everything else eight bytes."""
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(col)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            size = F.size(col) * 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(col))
        else:
            size = F.lit(8)
        width = width + F.coalesce(size, F.lit(0)) + F.lit(8)
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def row_hash_salt(*cols: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def all_salts(salts: int = SALTS) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))


def global_positions(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number all rows 1.. (plus ``start``) in the given order without one global window.

    Rows are range-partitioned and sorted, each gets its place inside its partition, and
    the result is checkpointed so that the places cannot change on a retry.  Only one
    count per partition is then summed up and broadcast (its size is the partition count).
    Runs one job.
    """
    keys = [F.col(c) for c in order]
    placed = reliable_checkpoint(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    )
    part, offset = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("_part", part).withColumn("_offset", offset)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_before") + F.col("_offset") + 1 + start).cast("long"))
        .drop("_place", "_part", "_offset", "_before")
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Scan with fewer splits than cores (a few large row groups), spread by a unique key
    before CPU-heavy work.  A scan that already fills the cluster is left alone."""
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
    return df


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, position: str) -> DataFrame:
    """First ``n`` rows per key with their 1-based position.  With a fixed ``n`` Spark cuts
    every group to ``n`` rows before the shuffle, so a hot key stays small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= n)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running totals over all rows without one global window.

    ``sums`` maps new names to columns.  Rows are range-partitioned by the (distinct) order
    and checkpointed with their partition number; totals run inside each partition and the
    sums of the earlier partitions, one row each, are broadcast on top.  Runs one job.
    """
    placed = reliable_checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(parts), "_part")
    for name, column in sums.items():
        out = out.withColumn(name, F.sum(column).over(inside) + F.col(f"_b_{name}"))
    return out.drop("_part", *[f"_b_{n}" for n in sums])


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is shuffled and never sent through the driver, for keys that
    grow with the input.  Spark broadcasts rows below its threshold, and the hash table of 10 MB of
    keys takes some 50 MB of the driver, once per join that runs at a time."""
    return df.hint("merge")


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str, spread_by: list[str], salts: int = SALTS) -> DataFrame:
    """Join where one key may own a large part of ``big``: its rows are split over salts
    by other columns, and the (narrow) rows of ``small`` are repeated once per salt.

    They are repeated by a cross join with the salts: Spark takes the size of a join's result for
    the product of both sides, but that of an ``explode`` for the size of its input.  Neither side
    is sent through the driver, where the measured size is below the threshold either."""
    numbers = small.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_salt"))
    left = big.withColumn("_salt", row_hash_salt(*spread_by, salts=salts))
    right = small.crossJoin(F.broadcast(numbers))
    return left.join(unsent(right), [key, "_salt"], how).drop("_salt")


def hot_key_join(big: DataFrame, unique: DataFrame, key: str, hot_rows: int = 1_000_000) -> DataFrame:
    """Inner join with a table that has one row per key and is as long as ``big``.

    Keys with more than ``hot_rows`` rows are joined by broadcasting their rows of
    ``unique``; the rest is a plain join.  The hot keys are measured: where they are too many
    for a broadcast, the join is salted for all rows.
    """
    hot = reliable_checkpoint(big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(key))
    if not fits_broadcast(hot):
        return salted_join(big, unique, key, "inner", [c for c in big.columns if c != key])
    few = F.broadcast(unique.join(F.broadcast(hot), key, "left_semi"))
    cold = big.join(F.broadcast(hot), key, "left_anti")
    return big.join(few, key).unionByName(cold.join(unique, key))
