"""Whole jobs over tables: ingest documents, verify claims, record, evaluate, calibrate, replay.

A judge is a function of two tables, claims (claim_id, claim, mode) and their hydrated hits,
that returns verdict columns.  ``judges.lexical_judge`` is built in; ``prompted`` wraps a
plug-in that answers batches of (claim_id, claim, corpus text).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchspark import schemas
from vouchspark.functions.ids import stable_id
from vouchspark.operators import corpus as C
from vouchspark.operators import evaluate as E
from vouchspark.operators import judges as J
from vouchspark.operators import retrieval as R
from vouchspark.operators import runs as T
from vouchspark.operators import verify as V
from vouchspark.operators.scaling import fits_broadcast, salted_join
from vouchspark.session import reliable_checkpoint

Judge = Callable[[DataFrame, DataFrame], DataFrame]

K, POOL = 10, 50
CITING, YES_NO = ("evidence", "judgment"), ("binary", "arithmetic")
MATCHED = ("evidence",)
ANY_VERSION = 2**62
RESULT = ("claim_id", "claim", "mode", "label", "confidence", "reasoning", "supporting_chunk_ids", "contradicting_chunk_ids", "missing_information")
#: Set in tiered mode (tier, escalated, the threshold in force) and in decomposed mode (atoms).
EXTRA = {"tier": "int", "escalated": "boolean", "threshold": "double", "atom_verdicts": "array<struct<atom:string,label:string,confidence:double>>"}


def ingest_documents(batch: DataFrame, evidence: DataFrame | None = None, *, start: int = 0, **chunking) -> tuple[DataFrame, DataFrame]:
    """(evidence, chunks) of the new documents of a batch (doc_id, text, source_path, mime_type).
    Documents without a text are in neither: ``corpus.quarantined(batch)`` names them."""
    new = C.stamp_versions(C.with_evidence_id(C.new_evidence(batch, evidence)), start)
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"(?<=.)\.[^.]*\z", "")
    titled = C.with_title(new, stem)
    carried = titled.select("evidence_id", "sha256", "corpus_version", "text")
    return titled.drop("text"), C.chunk_documents(carried, **chunking)


def prompted(judge_fn: J.JudgeFn, schema: str, parallelism: int | None = None) -> Judge:
    """A judge from a plug-in that sees one request per claim with its corpus block."""

    def run(claims: DataFrame, hits: DataFrame) -> DataFrame:
        requests = claims.join(J.corpus_block(hits), "claim_id").select("claim_id", "claim", "mode", "corpus")
        return J.judge(requests, judge_fn, schema, parallelism)

    return run


def find_candidates(claims: DataFrame, corpus: R.Corpus, *, k: int = K, pool: int = POOL) -> DataFrame:
    """Hits of routed claims: by words for evidence mode, the whole staged passage for the others.

    A claim may carry ``evidence_id`` (its passage) and ``as_of`` (its snapshot, which holds on
    every path), and its own ``k`` and ``retrieval_pool``: one retrieval as deep as the largest pool
    serves all.  A claim without a passage is matched by words as well: no prefix of the corpus
    can stand in for it."""
    blank = {"evidence_id": "string", "as_of": "long", "k": "int", "retrieval_pool": "int"}
    own_sizes = {"k", "retrieval_pool"} & set(claims.columns)
    for name, kind in blank.items():
        if name not in claims.columns:
            claims = claims.withColumn(name, F.lit(None).cast(kind))
    asked = claims.select(
        F.col("claim_id").alias("query_id"), F.col("claim").alias("query"), "mode", "evidence_id", F.coalesce("as_of", F.lit(ANY_VERSION)).alias("as_of"),
        F.coalesce("k", F.lit(k)).cast("int").alias("_k"), F.coalesce("retrieval_pool", F.lit(pool)).cast("int").alias("_pool"),
    )
    by_match = F.col("mode").isin(*MATCHED) | F.col("evidence_id").isNull()
    by_words = asked.filter(by_match)
    most = (by_words.agg(F.max("_pool")).first()[0] or pool) if own_sizes else pool
    matched = R.retrieve(by_words.select("query_id", "query", "as_of"), corpus, limit=most, version_per_query=True)
    sized = matched.join(by_words.select("query_id", "_k", "_pool"), "query_id").filter((F.col("rank") < F.col("_k")) & (F.col("rank") < F.col("_pool")))
    considered = F.when(F.col("method") == "bm25", F.least("candidates_considered", F.col("_pool"))).otherwise(F.col("candidates_considered"))
    found = sized.select("query_id", "chunk_id", "rank", "score", "method", considered.alias("_considered"))
    passages = asked.filter(~by_match)
    method = F.concat("mode", F.lit("_all"))
    staged = R.select_all_each(passages.select("query_id", "evidence_id", "as_of"), corpus.chunks)
    whole = staged.select("query_id", "chunk_id", "rank", "score", "chunks_found").join(passages.select("query_id", method.alias("method")), "query_id")
    whole = whole.withColumn("_considered", F.col("chunks_found")).drop("chunks_found")
    both = found.unionByName(whole)
    return both.withColumnRenamed("_considered", "candidates_considered").withColumnRenamed("query_id", "claim_id")


def _hydrated(hits: DataFrame, corpus: R.Corpus) -> DataFrame:
    named = hits.withColumnRenamed("claim_id", "query_id")
    return R.hydrate(named, corpus.chunks, corpus.evidence).withColumnRenamed("query_id", "claim_id")


def _yes_no(verdicts: DataFrame) -> DataFrame:
    """A verdict read as yes or no: anything but support is not found, nothing is cited."""
    return V.map_binary(verdicts.withColumn("faithful", F.col("label") == "supported").drop("label", "missing_information"))


def _finish(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    return verdicts.drop("claim", "mode").join(claims.select("claim_id", "claim", "mode"), "claim_id").select(*RESULT, *EXTRA)


def verify_claims(
    claims: DataFrame, corpus: R.Corpus, judge: Judge = J.lexical_judge, *, k: int = K, pool: int = POOL,
    threshold: float = V.DEFAULT_THRESHOLD, decompose_fn: V.DecomposeFn | None = None, second_judge: Judge | None = None, policy: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, hits) for a table of claims (claim_id, claim, domain or mode, …).

    Hits are stored once and read by every step.  Claims without hits are answered without
    the judge.  In tiered mode ``judge`` answers yes or no, and only claims below the threshold are
    retrieved and judged again, by ``second_judge``; ``tier`` and ``escalated`` say which answer ships.
    The threshold is that of the claim's ``workspace`` in ``policy`` (workspace, escalation_threshold),
    else ``threshold``.  In decomposed mode ``atom_verdicts`` lists the atoms, redacted.
    """
    routed = V.route_modes(claims if "domain" in claims.columns else claims.withColumn("domain", F.lit(None).cast("string")),
                           explicit="mode" if "mode" in claims.columns else None)
    cut = F.lit(threshold)
    if policy is not None and "workspace" in routed.columns:
        # One row per workspace; a workspace may hold most claims, so the policy is broadcast if it fits.
        known = policy.select("workspace", F.col("escalation_threshold").alias("_cut"))
        routed = routed.join(F.broadcast(known) if fits_broadcast(known) else known, "workspace", "left")
        cut = F.coalesce("_cut", cut)
    routed = reliable_checkpoint(routed.withColumn("_threshold", cut.cast("double")).drop("_cut"))
    first = routed.withColumn("mode", F.when(F.col("mode") == "tiered", "binary").otherwise(F.col("mode")))
    hits = reliable_checkpoint(_hydrated(find_candidates(first, corpus, k=k, pool=pool), corpus))
    heard = routed.join(hits.select("claim_id").distinct(), "claim_id", "left_semi")
    cited = hits.select("claim_id", "chunk_id", "rank")

    def ask(mode_set: tuple[str, ...]) -> DataFrame:
        chosen = heard.filter(F.col("mode").isin(*mode_set))
        return judge(chosen.select("claim_id", "claim", "mode"), hits.join(chosen.select("claim_id"), "claim_id", "left_semi"))

    citing = V.guarded_verdicts(ask(CITING), cited)
    flat = _yes_no(ask(YES_NO))
    atoms = V.decompose(heard.filter(F.col("mode") == "decomposed"), decompose_fn)
    atom_id = F.concat_ws("-", F.col("claim_id").cast("string"), F.col("atom_index").cast("string"))
    named = atoms.select(atom_id.alias("atom_id"), "claim_id", "atom_index", "atom")
    atom_hits = hits.join(named.select("claim_id", "atom_id"), "claim_id").drop("claim_id").withColumnRenamed("atom_id", "claim_id")
    votes = _yes_no(judge(named.select(F.col("atom_id").alias("claim_id"), F.col("atom").alias("claim"), F.lit("binary").alias("mode")), atom_hits))
    votes = reliable_checkpoint(votes.withColumnRenamed("claim_id", "atom_id").join(named.select("atom_id", "claim_id"), "atom_id").select("atom_id", "claim_id", "label", "confidence"))
    none = F.array().cast("array<string>")
    voted = V.vote(votes).withColumns({
        "reasoning": F.concat(F.lit("Decomposed into "), F.col("atoms").cast("string"), F.lit(" atoms.")),
        "supporting_chunk_ids": none, "contradicting_chunk_ids": none, "missing_information": F.lit(None).cast("string"),
    })
    voted = voted.join(V.answered_atoms(named, votes, cited), "claim_id", "left")
    bar = routed.select("claim_id", F.col("_threshold").alias("threshold"))
    one = reliable_checkpoint(_yes_no(ask(("tiered",))).join(bar, "claim_id"))
    unsure = routed.join(V.needs_second_tier(one, F.col("threshold")).select("claim_id"), "claim_id", "left_semi").withColumn("mode", F.lit("evidence"))
    second_hits = reliable_checkpoint(_hydrated(find_candidates(unsure, corpus, k=k, pool=pool), corpus))
    two = V.guarded_verdicts((second_judge or judge)(unsure.select("claim_id", "claim", "mode"), second_hits), second_hits.select("claim_id", "chunk_id", "rank"))
    two = two.unionByName(J.empty_verdicts(unsure, second_hits), allowMissingColumns=True).join(bar, "claim_id")
    two = two.withColumns({"tier": F.lit(2), "escalated": F.lit(True)})
    sure = one.filter(F.col("confidence") >= F.col("threshold")).withColumns({"tier": F.lit(1), "escalated": F.lit(False)})
    silent = J.empty_verdicts(routed, hits).join(routed.select("claim_id", "mode", F.col("_threshold").alias("threshold")), "claim_id")
    tiered = F.col("mode") == "tiered"  # answered at once, with full confidence
    silent = silent.withColumns({"tier": F.when(tiered, 1), "escalated": F.when(tiered, False), "threshold": F.when(tiered, F.col("threshold"))})
    columns = [c for c in RESULT if c not in ("claim", "mode")]
    shaped = []
    for part in (citing, flat, voted, sure, two, silent):
        extra = [(F.col(c) if c in part.columns else F.lit(None)).cast(kind).alias(c) for c, kind in EXTRA.items()]
        shaped.append(part.select(*columns, *extra))
    # What an escalated claim was judged by are its second hits.
    final = hits.join(unsure.select("claim_id"), "claim_id", "left_anti").unionByName(second_hits)
    return _finish(reduce(DataFrame.unionByName, shaped), routed), final


def verify_documents(docs: DataFrame, corpus: R.Corpus, judge: Judge = J.lexical_judge, *, extract_fn: V.ExtractFn | None = None, **options) -> DataFrame:
    """Every claim of every document (doc_id, text) retrieved and verified on its own: doc_id,
    claim_index, the verdict's columns and ``error`` of an extraction that failed.

    Documents share claims, so each distinct one is found and judged once, under its hash; the
    verdicts go back to (document, claim) over salts, as one claim may be in most documents.
    ``verify.label_counts(…, ["doc_id"])`` counts labels.  ``part`` and ``claim_index`` order a document's claims."""
    found = reliable_checkpoint(V.extract_claims(docs, extract_fn).withColumn("claim_id", F.sha2(F.col("claim"), 256)))
    once = found.filter(F.col("claim").isNotNull()).groupBy("claim_id").agg(F.first("claim").alias("claim"))
    for name in ("domain", "mode"):
        if name in options:
            once = once.withColumn(name, F.lit(options.pop(name)))
    verdicts, _ = verify_claims(reliable_checkpoint(once), corpus, judge, **options)
    listed = salted_join(found.drop("claim"), reliable_checkpoint(verdicts), "claim_id", "left", ["doc_id", "part", "claim_index"])
    return listed.drop("claim_id")


def research(topics: DataFrame, corpus: R.Corpus, writer: Callable, *, k: int = V.TOPIC_K, pool: int = V.TOPIC_POOL) -> DataFrame:
    """Synthesis of topics (topic_id, topic) that retrieves for itself: the best ``k`` of a pool."""
    asked = topics.select(F.col("topic_id").alias("query_id"), F.col("topic").alias("query"))
    hits = R.retrieve(asked, corpus, limit=pool).filter(F.col("rank") < k)
    hydrated = reliable_checkpoint(_hydrated(hits.withColumnRenamed("query_id", "claim_id"), corpus))
    return V.research_topics(topics, hydrated, writer)


def as_traces(verdicts: DataFrame, hits: DataFrame, *, workspace: str, started_at: str, corpus_version: int) -> DataFrame:
    """One trace document per verified claim, ready for ``sources.traces.write_traces``."""
    returned = F.array_sort(
        F.collect_list(
            F.struct(
                F.col("rank").cast("int").alias("rank"), "chunk_id", "evidence_id", F.col("score").alias("bm25_score"), "headings_path", "evidence_title"
            )
        )
    )
    per_claim = hits.groupBy("claim_id").agg(F.first("method").alias("method"), F.first("candidates_considered").alias("considered"), returned.alias("returned"))
    order = ("chunk_id", "evidence_id", "rank", "bm25_score", "headings_path", "evidence_title")
    shaped = F.transform("returned", lambda r: F.struct(*[r[c].alias(c) for c in order]))
    joined = verdicts.join(per_claim, "claim_id", "left")
    inputs = F.create_map(F.lit("claim"), F.col("claim"), F.lit("mode"), F.col("mode"))
    known = {
        "schema_version": F.lit(schemas.TRACE_VERSIONS[-1]), "run_id": stable_id(F.lit("run"), F.lit(started_at), F.col("claim_id").cast("string")),
        "directive": F.lit("research"), "skill": F.lit("verify_claim"), "workspace": F.lit(workspace), "corpus_version": F.lit(corpus_version).cast("long"),
        "started_at": F.lit(started_at), "status": F.lit("ok"), "inputs": inputs, "effective_kwargs": inputs,
        "retrieval": F.when(F.col("method").isNotNull(), F.struct(F.col("method"), F.col("considered").alias("candidates_considered"), shaped.alias("returned"))),
        "output": F.to_json(F.struct("claim", "label", "confidence", "reasoning", "supporting_chunk_ids", "contradicting_chunk_ids", "missing_information")),
    }
    return joined.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TRACE.fields])


def evaluate_gold(gold: DataFrame, corpus: R.Corpus, judge: Judge = J.lexical_judge, *, current_version: int, mode: str = "evidence", k: int = K) -> DataFrame:
    """Every gold claim verified at its own snapshot and scored in one report row."""
    asked = gold.select("claim_id", "claim", F.lit(mode).alias("mode"), F.col("corpus_version").alias("as_of"))
    verdicts, hits = verify_claims(asked, corpus, judge, k=k)
    return E.run_eval(verdicts, gold, hits, current_version=current_version)


def calibrate(gold: DataFrame, corpus: R.Corpus, judge: Judge = J.lexical_judge, *, target: float = 0.95) -> DataFrame:
    """Escalation threshold from yes/no verdicts on the gold set."""
    asked = gold.select("claim_id", "claim", F.lit("binary").alias("mode"), F.col("corpus_version").alias("as_of"))
    verdicts, _ = verify_claims(asked, corpus, judge)
    rows = verdicts.join(gold.select("claim_id", "expected_label"), "claim_id").select(
        F.col("label").alias("predicted"), F.col("expected_label").alias("expected"), "confidence"
    )
    return E.sweep(E.tier1_results(rows), target)


@dataclass(frozen=True)
class Replay:
    """New verdicts, what drifted, and the new runs as trace documents with their lineage."""

    verdicts: DataFrame
    drift: DataFrame
    runs: DataFrame


def replay(
    traces: DataFrame, corpus: R.Corpus, judge: Judge = J.lexical_judge, *, started_at: str, live: bool = False, defaults: dict[str, str] | None = None,
    second_judge: Judge | None = None, policy: DataFrame | None = None, current_version: int | None = None,
) -> Replay:
    """Recorded claim verifications run again with all their arguments (claim, mode, domain, k,
    retrieval_pool, evidence_id), in one job whatever they ask for; frozen at their version or live.

    A new run's ``inputs`` are the original ones with ``_replay_of``, ``_replay_mode``,
    ``_original_corpus_version`` and ``_kwargs_source``; its ``effective_kwargs`` are the arguments used,
    with the pinned ``corpus_version`` in a frozen one."""
    requests = reliable_checkpoint(T.replay_requests(traces, defaults or {}, live=live))
    arg = lambda name, kind: F.try_element_at("kwargs", F.lit(name)).cast(kind).alias(name)
    asked = requests.select(
        F.col("query_id").alias("claim_id"), F.col("query").alias("claim"), arg("mode", "string"), arg("domain", "string"), arg("k", "int"),
        arg("retrieval_pool", "int"), arg("evidence_id", "string"), "workspace", "as_of",
    )
    verdicts, hits = verify_claims(asked, corpus, judge, second_judge=second_judge, policy=policy)
    verdicts, hits = reliable_checkpoint(verdicts), reliable_checkpoint(hits)
    ids = lambda source: F.array_sort(F.transform(source, lambda r: r["chunk_id"]))
    old = traces.select(
        "run_id", F.col("retrieval.method").alias("method"), F.get_json_object("output", "$.label").alias("label"),
        F.get_json_object("output", "$.confidence").cast("double").alias("confidence"), ids(F.col("retrieval.returned")).alias("chunk_ids"),
    )
    sets = hits.groupBy("claim_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.first("method").alias("method"))
    new = verdicts.select("claim_id", "label", "confidence").join(sets, "claim_id", "left").withColumnRenamed("claim_id", "run_id")
    made = as_traces(verdicts, hits, workspace="", started_at=started_at, corpus_version=0).drop("workspace", "corpus_version", "inputs", "effective_kwargs").withColumnRenamed("run_id", "_id")
    pair = lambda key, value: F.create_map(F.lit(key), value.cast("string"))
    kept = F.map_filter(F.coalesce("inputs", F.create_map().cast("map<string,string>")), lambda name, _: ~name.isin("_replay_of", "_replay_mode", "_original_corpus_version", "_kwargs_source"))
    lineage = F.map_concat(kept, pair("_replay_of", F.col("query_id")), pair("_replay_mode", F.col("mode")), pair("_original_corpus_version", F.col("original_corpus_version")), pair("_kwargs_source", F.col("kwargs_source")))
    used = F.map_filter("kwargs", lambda name, _: name != "corpus_version")
    if not live:
        used = F.map_concat(used, pair("corpus_version", F.col("original_corpus_version")))
    version = F.lit(current_version).cast("long") if live else F.col("original_corpus_version").cast("long")
    own = requests.select(
        stable_id(F.lit("run"), F.lit(started_at), F.col("query_id").cast("string")).alias("_id"), stable_id(F.lit("replay"), F.lit(started_at), F.col("query_id").cast("string")).alias("run_id"),
        "workspace", version.alias("corpus_version"), lineage.alias("inputs"), used.alias("effective_kwargs"),
    )
    runs = made.join(own, "_id").select(*[F.col(f.name).cast(f.dataType) for f in schemas.TRACE.fields])
    return Replay(verdicts, T.replay_diff(old, new), runs)


def replay_runs(traces: DataFrame, corpus: R.Corpus, judge: Judge = J.lexical_judge, *, live: bool = False, defaults: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new verdicts, drift) of ``replay``."""
    again = replay(traces, corpus, judge, started_at="", live=live, defaults=defaults)
    return again.verdicts, again.drift
