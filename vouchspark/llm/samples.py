"""Held-out split and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.storage import stored
from vouchspark.operators.scaling import first_rows


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids whose crc32 as text leaves 1 modulo 3; NULL ids are held out as well."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample_keys(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows of a narrow table, the same ones on every run: those with the
    smallest seeded hash.  Small enough to broadcast, whatever the input."""
    order = [F.xxhash64(F.lit(seed), *df.columns), *df.columns]
    return df.orderBy(*order).limit(rows)


def stratified_keys(df: DataFrame, by: str, least: int, rows: int, seed: int) -> DataFrame:
    """``sample_keys`` in which no value of ``by`` is forgotten: a value with fewer than ``least``
    rows in the sample gets its first ``least`` rows by the same hash, or all it has, in place of
    the last rows of the others.  Beyond ``rows`` such rows every value has its first ones first.

    Only values that are rare in a uniform sample are ranked, so no window meets a hot key.
    """
    names = df.columns
    uniform = stored(sample_keys(df, rows, seed), "sample")
    enough = uniform.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(by)
    rare = stored(df.select(by).distinct().join(enough, by, "left_anti"), "rare")
    if rare.isEmpty():
        return uniform
    order = [F.xxhash64(F.lit(seed), *names), *names]
    ranked = first_rows(df.join(rare, by, "left_semi").select(*names), [by], order, least, "_at")
    others = uniform.join(rare, by, "left_anti").select(*names, F.lit(least + 1).alias("_at"))
    return ranked.select(*names, "_at").unionByName(others).orderBy("_at", *order).limit(rows).select(*names)
