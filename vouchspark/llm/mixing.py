"""Mixing sources to target weights by capped water-filling.

Sources share the total size by weight.  A source stops at ``max_epochs`` times its own size;
what it leaves is shared again by weight, until no source is above its cap.  Every source then
repeats its documents whole as often as they fit, and a seeded order of its documents decides
which of them are taken once more; the last one in that order is taken in part, so that the
words taken equal the target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchspark.llm.storage import stored
from vouchspark.operators.scaling import all_salts, fits_broadcast, global_positions, row_hash_salt

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20240
#: Slices of the seeded order of a source; only the documents of one slice are put in order.
SLICE_BITS = 14
OUTPUTS = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``_source`` (key that is never NULL), ``source_size``, ``target``.

    ``sized`` has ``source`` and ``size``.  Sources come in order of code points, NULL last, and
    take the weights in turn.  Every round of the filling is one aggregate over the source
    table; the driver sees its single row.  An empty table has no source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("_none", F.col("source").isNull().cast("int"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = stored(global_positions(sizes, ["_none", "source"], "_rank").withColumn("_weight", pick.cast("long")), "sources")
    level, clamped, cap = None, -1, F.col("source_size") * max_epochs
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("_weight") > cap
        row = table.agg(
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0)).alias("open"),
        ).first()
        if row["n"] == clamped or not row["open"]:
            break
        clamped, level = row["n"], (total - row["full"]) / row["open"]
    target = F.least(cap.cast("double"), F.lit(float(level or 0.0)) * F.col("_weight"))
    return table.select(source_key("source").alias("_source"), "source_size", target.alias("target"))


def source_key(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(name)))


@dataclass
class Plan:
    """``table`` has a row per source: whole repeats, and where the last partial repeat stops."""

    table: DataFrame
    small: bool


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))


def _slice(seed: int) -> Column:
    return F.shiftrightunsigned(_order(seed), 64 - SLICE_BITS)


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> Plan:
    """Decide repeats per source from ``doc_id``, ``source``, ``size``.

    The seeded order of a source is cut into 2^14 slices.  Sizes are summed per slice, so a
    source that holds a third of all rows is a partial sum in every task; running sums over
    slices give the slice in which the target is reached.
    """
    targets = source_targets(sized, weights, max_epochs)
    slices = sized.groupBy(source_key("source").alias("_source"), _slice(seed).alias("_slice")).agg(F.sum("size").alias("_in"))
    up_to = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round("target").cast("long") - F.col("_whole") * F.col("source_size")
    need = targets.withColumn("_whole", whole).withColumn("_rest", F.greatest(rest, F.lit(0).cast("long")))
    reached = (
        slices.withColumn("_sum", F.sum("_in").over(up_to)).join(need.select("_source", "_rest"), "_source")
        .filter((F.col("_sum") - F.col("_in") <= F.col("_rest")) & (F.col("_rest") < F.col("_sum")))
        .select("_source", F.col("_slice").alias("_edge"), (F.col("_rest") - F.col("_sum") + F.col("_in")).alias("_left"))
    )
    table = stored(need.drop("_rest").join(reached, "_source", "left"), "mix")
    return Plan(table, fits_broadcast(table))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words,
    repeats counted).  ``docs`` needs ``doc_id``, ``source`` and ``text`` or a ready ``size``.

    A NULL or empty text has size 0 and is taken 0 times; a NULL source is a source of its own.
    Rows that repeat are judged one by one.  Other columns named like the outputs are replaced.
    Documents of the slice where a source's target is reached are put in order by a window per
    source (one document in 2^14); all others are decided where they lie.
    """
    if "size" not in docs.columns or "text" in docs.columns:
        docs = docs.withColumn("size", n_words(F.col("text")))
    docs = docs.drop(*OUTPUTS[1:])
    sized = stored(docs.select("doc_id", "source", "size"), "sizes")
    made = plan(sized, weights, max_epochs, seed)
    keyed = docs.withColumn("_source", source_key("source")).withColumn("_slice", _slice(seed))
    if made.small:
        joined = keyed.join(F.broadcast(made.table), "_source")
    else:
        salted = keyed.withColumn("_salt", row_hash_salt("doc_id", "size"))
        joined = salted.join(made.table.withColumn("_salt", all_salts()), ["_source", "_salt"]).drop("_salt")
    # No edge: the target is reached exactly at the end of the order.
    past = F.col("_edge").isNull() | (F.col("_slice") < F.col("_edge"))
    zero, size = F.lit(0).cast("long"), F.col("size")
    everything = F.col("_edge").isNull() & (F.round("target") >= F.col("source_size") * (F.col("_whole") + 1))
    away = joined.filter(~F.equal_null("_slice", "_edge")).withColumn("_more", F.when(past & (F.col("_edge").isNotNull() | everything), size).otherwise(zero))
    before = Window.partitionBy("_source").orderBy(_order(seed), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.filter(F.equal_null("_slice", "_edge")).withColumn("_done", F.coalesce(F.sum("size").over(before), zero))
    edge = edge.withColumn("_more", F.greatest(zero, F.least(size, F.col("_left") - F.col("_done")))).drop("_done")
    both = away.unionByName(edge)
    return both.withColumn("taken", size * F.col("_whole") + F.col("_more")).drop("_source", "_slice", "_whole", "_edge", "_left", "_more")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``: every document as often as
    it is taken.  Of a last partial repeat (one document per source at most) the text holds the
    words taken, joined by single blanks, and ``n_chars``, if there, is its new length."""
    columns = docs.columns
    mixed = mix(docs.select(*columns), weights, max_epochs, seed).filter(F.col("taken") > 0)
    full, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = mixed.withColumn("_part", part).withColumn("_copy", F.explode(F.sequence(F.lit(1), (full + (part > 0).cast("int")).cast("int"))))
    cut = (F.col("_part") > 0) & (F.col("_copy") * F.col("size") > F.col("taken"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), F.col("_part").cast("int"))
    out = copies.withColumn("_cut", cut).withColumn("text", F.when(F.col("_cut"), F.array_join(words, " ")).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)
