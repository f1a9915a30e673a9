"""URL verdicts by prefix rules and, beyond them, a tree of path templates per host.

DataFrame functions alone.  Runs of digits are written as 0, which leaves few path shapes; all
further work is on shapes with their counts, so a host that holds a third of all pages is a few
rows.  Level by level, down to the last segment of the deepest path, a position with many, rarely
repeated segments becomes a wildcard.  Pages that a rule decides label their template.  Sibling
templates whose labels do not differ significantly are merged, and a template is rejected when
its smoothed share of allowed pages is below one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.storage import shared_folder, stored
from vouchspark.operators.scaling import all_salts, fits_broadcast, row_hash_salt

#: Rules of the registered query: host, start of the path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: A position is variable with at least so many segments that repeat less than so often.
LEAST_SEGMENTS, LEAST_REPEATS = 8, 4
#: Critical value of the chi-square test with one degree of freedom at 5 %.
DIFFERENT = 3.841
#: Smoothing: so many pages are added to a template, this share of them allowed.
PRIOR_PAGES, PRIOR_ALLOWED = 4, 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host behind the first ``://`` and the path up to ``?`` or ``#``; both empty for a NULL or
    other url.  A-Z of the host is lower-cased."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def path_shapes(pages: DataFrame) -> DataFrame:
    """Pages, allowed pages and blocked pages by ``host`` and ``shape``; one partial aggregate."""
    return pages.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_ruled") == "allow").alias("a"), F.count_if(F.col("_ruled") == "block").alias("b")
    )


def generalised(shapes: DataFrame) -> DataFrame:
    """Add ``template`` and ``parent`` of every shape, whatever its depth.

    Each round takes one more segment of the shapes that have one; it ends when none is left.
    Below a node with fewer than ``LEAST_SEGMENTS`` shapes no position can be variable, so these
    shapes keep the rest of their segments as they are and leave the rounds.
    """
    spark, folder = shapes.sparkSession, shared_folder(shapes.sparkSession, "tree")
    out = shapes.withColumn("_s", F.slice(F.split("shape", "/"), 2, 1 << 30))
    out = out.withColumn("_m", F.when(F.col("shape") == "", 0).otherwise(F.size("_s")))
    out = out.withColumn("template", F.col("host")).withColumn("parent", F.col("host")).withColumn("_more", F.col("_m") > 0)
    k, at = 0, f"{folder}/level=0"
    while True:
        out.write.parquet(at)
        out = spark.read.schema(out.schema).parquet(at).filter("_more")
        if out.isEmpty():
            break
        k, at = k + 1, f"{folder}/level={k + 1}"
        own = F.get("_s", F.lit(k - 1))
        seen = out.groupBy("template", own.alias("_own")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_shapes")).groupBy("template")
        seen = seen.agg(F.count(F.lit(1)).alias("_d"), F.sum("n").alias("_n"), F.sum("_shapes").alias("_shapes"))
        variable = (F.col("_d") >= LEAST_SEGMENTS) & (F.col("_n") < LEAST_REPEATS * F.col("_d"))
        out = out.join(seen.filter(F.col("_shapes") >= LEAST_SEGMENTS).select("template", variable.alias("_any")), "template", "left")
        before, alone = F.col("template"), F.col("_any").isNull()
        rest = lambda less: F.concat_ws("/", before, F.slice("_s", k, F.col("_m") - (k - 1) - less))
        named = F.concat(before, F.lit("/"), F.when(F.col("_any"), F.lit("*")).otherwise(own))
        out = out.select(
            "host", "shape", "n", "a", "b", "_s", "_m", F.when(alone, rest(0)).otherwise(named).alias("template"),
            F.when(alone, rest(1)).otherwise(before).alias("parent"), (~alone & (F.col("_m") > k)).alias("_more"),
        )
    ended = spark.read.schema(out.schema).parquet(*[f"{folder}/level={i}" for i in range(k + 1)]).filter("not _more")
    return ended.select("host", "shape", "n", "a", "b", "template", "parent")


def sibling_groups(rows: DataFrame) -> DataFrame:
    """Add ``_ga`` and ``_gb``, the allowed and blocked pages that judge each template of
    ``host``, ``parent``, ``template`` with summed counts ``a`` and ``b``.

    A template differs from its siblings when a chi-square test on allowed and blocked pages
    says so; it is then judged alone.  All others, those without labels included, are judged by
    the pooled counts of their parent's templates that do not differ.
    """
    pool = rows.groupBy("parent").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    a, b, ra, rb = F.col("a"), F.col("b"), F.col("_a") - F.col("a"), F.col("_b") - F.col("b")
    below = (a + b) * (ra + rb) * F.col("_a") * F.col("_b")
    square = (a + b + ra + rb) * (a * rb - b * ra) * (a * rb - b * ra) / below
    rows = stored(rows.join(pool, "parent").withColumn("_alone", F.coalesce(F.when(below > 0, square >= DIFFERENT), F.lit(False))).drop("_a", "_b"), "branches")
    merged = rows.filter(~F.col("_alone")).groupBy("parent").agg(F.sum("a").alias("_ma"), F.sum("b").alias("_mb"))
    rows = rows.join(merged, "parent", "left")
    rows = rows.withColumn("_ga", F.when(F.col("_alone"), a).otherwise(F.col("_ma"))).withColumn("_gb", F.when(F.col("_alone"), b).otherwise(F.col("_mb")))
    return rows.drop("_alone", "_ma", "_mb")


def judged(allowed: Column, blocked: Column) -> Column:
    purity = (allowed + PRIOR_PAGES * PRIOR_ALLOWED) / (allowed + blocked + PRIOR_PAGES)
    return F.when(purity < 0.5, "block").otherwise("allow")


def summed(templates: DataFrame) -> DataFrame:
    return templates.groupBy("host", "parent", "template").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))


def template_verdicts(templates: DataFrame) -> DataFrame:
    """Verdict of every template, by its direct siblings alone; without labels, by the prior."""
    return sibling_groups(summed(templates)).select("host", "parent", "template", judged(F.col("_ga"), F.col("_gb")).alias("_judged"))


def branch_verdicts(templates: DataFrame) -> DataFrame:
    """Verdict of every template, with inner nodes compared and merged like templates.

    Every node has the summed counts of its subtree and is tested against its siblings, up to
    the children of the host; the host is judged by all its pages.  A template takes the counts
    of the deepest node on its path whose group has labels, and the prior where none has.
    """
    rows = stored(summed(templates), "summed")
    parts = F.split("template", "/")
    path = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.concat_ws("/", F.slice(parts, 1, i)).alias("node"), F.concat_ws("/", F.slice(parts, 1, i - 1)).alias("parent"),
    ))
    steps = rows.select("host", F.col("parent").alias("_own"), "template", "a", "b", F.explode(path).alias("_at"))
    # A host is the only child of a name that no node has.
    root = F.when(F.col("_at.depth") == 1, F.concat(F.lit("/"), F.col("host"))).otherwise(F.col("_at.parent"))
    nodes = steps.groupBy("host", root.alias("parent"), F.col("_at.node").alias("template")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    groups = sibling_groups(stored(nodes, "nodes")).filter("_ga + _gb > 0").select(F.col("parent").alias("_above"), F.col("template").alias("_node"), "_ga", "_gb")
    steps = steps.select("host", F.col("_own").alias("parent"), "template", root.alias("_above"), F.col("_at.node").alias("_node"), F.col("_at.depth").alias("_depth"))
    found = steps.join(groups, ["_above", "_node"], "left").groupBy("host", "parent", "template").agg(
        F.max(F.when(F.col("_ga").isNotNull(), F.struct("_depth", "_ga", "_gb"))).alias("_best")
    )
    none = F.lit(0.0)
    verdict = judged(F.coalesce("_best._ga", none), F.coalesce("_best._gb", none))
    return found.select("host", "parent", "template", verdict.alias("_judged"))


def url_verdicts(pages: DataFrame, rules=RULES, branches: bool = False) -> DataFrame:
    """All columns of ``pages`` (with ``url``) and ``host``, ``path``, ``rule``, ``verdict``.

    With ``branches`` inner nodes are merged too and evidence higher up decides where a template
    and its siblings have no labels; without, such pages are allowed (the registered query, as its
    SQL has it).  A NULL url, or one without ``://``, has an empty host and path and no rule.  Existing columns
    named like the outputs are replaced.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.drop("host", "path", "rule", "verdict").withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", name).withColumn("_ruled", verdict).withColumn("shape", F.regexp_replace("path", "[0-9]+", "0"))
    templates = stored(generalised(stored(path_shapes(parsed), "shapes")), "templates")
    known = templates.join((branch_verdicts if branches else template_verdicts)(templates), ["host", "parent", "template"]).select("host", "shape", "_judged")
    known = stored(known, "verdicts")
    if fits_broadcast(known):
        out = parsed.join(F.broadcast(known), ["host", "shape"])
    else:
        salted = parsed.withColumn("_salt", row_hash_salt("url"))
        out = salted.join(known.withColumn("_salt", all_salts()), ["host", "shape", "_salt"]).drop("_salt")
    return out.withColumn("verdict", F.coalesce("_ruled", "_judged")).drop("_ruled", "_judged", "shape")
