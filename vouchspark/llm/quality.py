"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A base test needs the counts of every text.  Texts that pass go through rules; for each rule its
time per text and its share of rejections are measured on a bounded sample, and the cascade asks
rules in order of rejections per second.  The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.samples import sample_keys
from vouchspark.llm.storage import stored

BLANKS = " \t\n\x0b\x0c\r"
WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Bound of the sample on which rules are measured.
SAMPLE_ROWS, SEED = 2000, 3
#: Judgements over which a rule is timed.
TIMED_ROWS = 8_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _neighbours(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Items of a sorted array that are the same as the one before or behind."""
    equal = lambda x, other: F.coalesce(same(x, other), F.lit(False))
    return F.filter(items, lambda x, i: equal(x, F.get(items, i - 1)) | equal(x, F.get(items, i + 1)))


def repeated_positions(words: Column) -> Column:
    """First positions (from 0) of three-word windows that occur twice or more.

    A window is one number, its hash above its position.  Sorting these numbers puts windows of
    one hash side by side; the few that share one are then compared as words.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    width = F.length(F.bin(F.size(words).cast("long")))
    low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1)
    high = lambda x: F.call_function("shiftright", x, width)
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    keys = F.sort_array(F.transform(places, lambda i: F.call_function("shiftleft", window(i), width).bitwiseOR(i.cast("long"))))
    alike = bound(keys, lambda k: F.transform(_neighbours(k, lambda x, y: high(x) == high(y)), lambda x: low(x).cast("int")))
    spelled = lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))
    same = bound(F.array_sort(F.transform(alike, spelled)), lambda s: _neighbours(s, lambda x, y: x["w"] == y["w"]))
    return F.transform(same, lambda x: x["i"])


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur twice or more."""
    spans = F.transform(repeated_positions(words), lambda i: F.array(i, i + 1, i + 2))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(spans))))


def text_counts(text: Column) -> Column:
    """Struct of ``COUNTS`` as long numbers; a NULL text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    bare = lambda t: F.translate(t, BLANKS, "")
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    of_words = bound(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: bare(x) != "")
    of_lines = bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    long = lambda c, name: c.cast("long").alias(name)
    return F.struct(
        long(of_words["n"], "n_words"), long(F.char_length(bare(text)), "word_chars"),
        long(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")), "n_symbols"),
        long(of_lines["d"], "n_dup_lines"), long(of_lines["n"], "n_lines"), long(of_words["r"], "n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rules by name; each is true for a text to reject.  They read ``text`` and the counts."""
    calls = F.char_length("text") - F.char_length(F.translate("text", "!?", ""))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "calls": 2 * calls > F.col("n_words"),
        "copied_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
        "letters": 2 * F.regexp_count("text", F.lit(r"\p{L}")) < F.col("word_chars"),
    }


def measured(counted: DataFrame, of: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Seconds per text and share of rejections of each rule, on stored sample rows.

    A job's start would drown the cost of a rule on a few rows, so every row is judged many times
    inside one job (the copies are made by ``explode``, which nothing moves below), as often as
    makes about ``TIMED_ROWS`` judgements, and the time of a job with an idle rule is taken off.
    The share is smoothed, so a rule without a hit in the sample still has one and rules without
    hits go by their cost."""
    rows = counted.count()
    if not rows:
        return {name: (1.0, 0.0) for name in of}
    times = max(1, TIMED_ROWS // rows)
    many = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def seconds(rule: Column) -> float:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            # A rule over the copy's number too is not the same value for all copies of a row.
            many.agg(F.count_if(rule | (F.col("_copy") < 0))).first()
            best = min(best, time.perf_counter() - start)
        return best

    hits = counted.agg(*[F.count_if(rule).alias(name) for name, rule in of.items()]).first()
    idle = seconds(F.length("text") < 0)
    return {name: (max(seconds(rule) - idle, 1e-3) / (rows * times), (hits[name] + 0.5) / (rows + 1)) for name, rule in of.items()}


def cascade_order(counted: DataFrame, of: dict[str, Column]) -> list[str]:
    """Names of rules by rejections per second, measured on a stored sample of counted texts that
    passed the base test; what is equal goes by cost, then as declared."""
    cost = measured(counted, of)
    return sorted(of, key=lambda name: (-cost[name][1] / cost[name][0], cost[name][0], list(of).index(name)))


def judged(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` (``doc_id``, ``text``) with the counts, ``base_failed`` and ``kept``.

    A NULL or empty text has no words and fails the base test.  Existing columns named like the
    outputs are replaced.  No shuffle; the sample is at most ``sample_rows`` texts.
    """
    docs = docs.drop(*COUNTS, "base_failed", "kept", "_counts")
    keys = sample_keys(docs.select("doc_id"), sample_rows, seed)
    # Stored before anything is counted: a filter on counts would move below the join.
    sample = stored(docs.join(F.broadcast(keys.distinct()), "doc_id", "left_semi").select("text"), "sample")
    passed = _counted(sample).filter(~F.col("base_failed"))
    of = rules()
    order = cascade_order(stored(passed.select("text", *COUNTS), "passed"), of)
    # CASE asks its branches in turn and stops at the first that holds.
    verdict = F.when(F.col("base_failed"), False)
    for name in order:
        verdict = verdict.when(of[name], False)
    return _counted(docs).withColumn("kept", verdict.otherwise(True))


def _counted(docs: DataFrame) -> DataFrame:
    counted = docs.withColumn("_counts", text_counts(F.col("text")))
    return counted.select("*", *[F.col(f"_counts.{c}").alias(c) for c in COUNTS]).drop("_counts").withColumn("base_failed", base_failed())
