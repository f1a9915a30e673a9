"""Tables of the data model, derived from the given parquet files (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchspark import schemas
from vouchspark.functions.ids import stable_id
from vouchspark.operators import corpus as C
from vouchspark.operators import retrieval as R
from vouchspark.operators.scaling import global_positions, spread, unsent
from vouchspark.session import reliable_checkpoint, stored

TARGET, OVERLAP = 200, 25
TOP_K = 10


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def iso(col: Column) -> Column:
    """ISO-8601 text in UTC with milliseconds, as stored and compared."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


def unversioned(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence before version stamping."""
    new = C.with_evidence_id(C.new_evidence(documents(spark, sf)))
    return new.select(
        "evidence_id", "sha256", "doc_id", "text", "lang", "source",
        F.lit("text/plain").alias("mime_type"),
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"),
        F.col("doc_id").cast("string").alias("title"),
        F.concat(F.lit("ws"), (F.col("doc_id") % 4).cast("string")).alias("workspace"),
    )


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return C.stamp_versions(unversioned(spark, sf))


def ch(spark: SparkSession, sf: str, versioned: bool = False) -> DataFrame:
    """Chunks; ``corpus_version`` is numbered only where a query needs snapshots."""
    docs = ev(spark, sf) if versioned else unversioned(spark, sf).withColumn("corpus_version", F.lit(1).cast("long"))
    docs = docs.select("evidence_id", "sha256", "text", "corpus_version", "workspace")
    return C.chunk_documents(docs, target=TARGET, overlap=OVERLAP, headings=False)


def stored_ch(spark: SparkSession, sf: str, versioned: bool = False) -> DataFrame:
    """The chunks cut once and stored, as an ingest would, for queries that read them several times:
    an index reads them for its frequencies and its postings, and its hits are hydrated from them."""
    return stored(ch(spark, sf, versioned))


DOMAINS = ("general", "legal", "clinical", "biomedical", "financial", "numeric")


def cl(spark: SparkSession, sf: str) -> DataFrame:
    domains = F.array(*[F.lit(d) for d in DOMAINS])
    return load(spark, sf, "benchmark").select(
        F.col("item_id").alias("claim_id"),
        F.col("text").alias("claim"),
        F.get(domains, (F.col("item_id") % 6).cast("int")).alias("domain"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return cl(spark, sf).select(F.col("claim_id").alias("query_id"), F.col("claim").alias("query"))


def hits(spark: SparkSession, sf: str, chunks: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """(claim_id, chunk_id, rank, score): BM25 of every claim over all chunks."""
    chunks = stored_ch(spark, sf) if chunks is None else chunks
    found = R.bm25_topk(questions(spark, sf), R.build_index(chunks), k)
    return found.withColumnRenamed("query_id", "claim_id")


def recorded_hits(spark: SparkSession, sf: str, chunks: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """The same, stored once as a run would record them (k rows per claim), for queries
    that read them several times."""
    return reliable_checkpoint(hits(spark, sf, chunks, k))


def fake(prefix: str, key: Column) -> Column:
    return stable_id(F.concat(F.lit(prefix), key.cast("string")))


def vd(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    """Recorded verdicts: real ids, planted fake ids, and prose that names both.

    The candidates of a claim are at most its top k, so gathering them is bounded."""
    found = recorded_hits(spark, sf) if found is None else found
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    per_claim = found.groupBy("claim_id").agg(F.transform(by_rank, lambda h: h["chunk_id"]).alias("candidates"))
    cid = F.col("claim_id")
    none = F.array().cast("array<string>")
    fake1, fake2 = fake("fake", cid), fake("other", cid)
    real_support = F.when(cid % 8 == 4, none).otherwise(F.slice("candidates", 1, 2))
    real_contra = F.when(cid % 8 == 1, F.slice("candidates", 3, 1)).otherwise(none)
    label = F.get(F.array(*[F.lit(x) for x in ("supported", "contradicted", "partial", "not_found")]), (cid % 4).cast("int"))
    return per_claim.select(
        "claim_id",
        "candidates",
        label.alias("label"),
        ((cid * 37 % 101) / F.lit(100.0)).alias("confidence"),
        F.concat(real_support, F.when(cid % 2 == 0, F.array(fake1)).otherwise(none)).alias("supporting_chunk_ids"),
        F.concat(real_contra, F.when(cid % 8 == 5, F.array(fake2)).otherwise(none)).alias("contradicting_chunk_ids"),
        F.concat(F.lit("Chunk "), F.get("candidates", F.lit(0)), F.lit(" backs this, unlike "), fake1, F.lit(".")).alias("reasoning"),
        F.when(cid % 2 == 1, F.concat(F.lit("Nothing beyond "), fake2, F.lit("."))).alias("missing_information"),
    )


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions on labelled documents."""
    base = unversioned(spark, sf).select("doc_id", "source").join(load(spark, sf, "labels"), "doc_id")
    good, other = F.lit("supported"), F.lit("not_found")
    expected = F.when(F.col("quality") == 1, good).otherwise(other)
    flipped = F.when(F.col("quality") == 1, other).otherwise(good)
    return base.select(
        "doc_id",
        F.col("source").alias("source_ds"),
        expected.alias("expected"),
        F.when(F.col("doc_id") % 31 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, flipped).otherwise(expected).alias("predicted"),
        (F.col("doc_id") * 7919 % 1001 / F.lit(1000.0)).alias("confidence"),
    )


def pred_big(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions at scale; confidences sit on bin edges."""
    return load(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("source_ds"),
        F.when(F.col("l_partkey") % 3 == 0, "supported").otherwise("not_found").alias("expected"),
        F.when(F.col("l_returnflag") == "N", "supported").otherwise("not_found").alias("predicted"),
        F.round(F.col("l_discount") * 10, 1).alias("confidence"),
    )


def gold(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    """Gold claims with relevant chunks (ranks 1, 3 and 12 where they exist)."""
    found = hits(spark, sf, k=13) if found is None else found
    cid = F.col("claim_id")
    relevant = F.array_sort(F.collect_list(F.when(F.col("rank").isin(1, 3, 12), F.col("chunk_id"))))
    per_claim = found.groupBy("claim_id").agg(relevant.alias("relevant"))
    label = F.get(F.array(F.lit("supported"), F.lit("contradicted"), F.lit("not_found")), (cid % 3).cast("int"))
    return per_claim.select(
        "claim_id",
        label.alias("expected_label"),
        F.when(cid % 5 != 0, F.col("relevant")).alias("relevant_chunk_ids"),
        (cid * 10 + 100).alias("corpus_version"),
    )


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"),
        F.when(F.col("l_returnflag") == "N", "supported").otherwise("not_found").alias("label"),
        F.round(F.col("l_discount") * 10, 1).alias("confidence"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    skill = (
        F.when(F.startswith("o_orderpriority", F.lit("1")), "verify_claim")
        .when(F.startswith("o_orderpriority", F.lit("2")), "search_evidence")
        .when(F.startswith("o_orderpriority", F.lit("3")), "extract_claims")
        .otherwise("research_topic")
    )
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        skill.alias("skill"),
        F.concat(F.lit("ws"), (F.col("o_custkey") % 8).cast("string")).alias("workspace"),
        (F.col("o_orderkey") % 50 + 1).alias("corpus_version"),
        iso(F.col("o_orderdate")).alias("started_at"),
        status.alias("status"),
        F.round("o_totalprice", 2).alias("cost"),
    )


def llm_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of a run; ``pos`` orders them by one comparable key, so no window is needed."""
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        F.get(F.array(F.lit("small"), F.lit("medium"), F.lit("large")), (F.col("l_suppkey") % 3).cast("int")).alias("model"),
        (F.col("l_quantity") * 10).cast("long").alias("input_tokens"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("output_tokens"),
        (F.col("l_partkey") % 50).alias("cache_read_input_tokens"),
        F.lit(0).cast("long").alias("cache_creation_input_tokens"),
    )


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """One nested document per run.  A trace holds all calls of its run by definition."""
    calls = llm_calls(spark, sf).groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("pos", "model", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
            )
        ).alias("calls")
    )
    rid = F.col("run_id")
    no_map = F.create_map().cast("map<string,string>")
    one = lambda key, value: F.create_map(F.lit(key), value.cast("string"))
    inputs = F.map_concat(
        one("claim", F.concat(F.lit("claim "), rid.cast("string"))),
        one("workspace", F.col("workspace")),
        F.when(rid % 3 != 0, one("_parent_run", rid - 1)).otherwise(no_map),
        F.when(rid % 3 != 0, one("_step_index", rid % 3 - 1)).otherwise(no_map),
        F.when(rid % 10 == 0, one("_replay_of", rid - 5)).otherwise(no_map),
        F.when(rid % 4 == 1, one("_eval_id", F.concat(F.lit("eval"), (rid % 9).cast("string")))).otherwise(no_map),
    )
    label = F.get(F.array(*[F.lit(x) for x in ("supported", "contradicted", "partial", "not_found")]), (rid % 4).cast("int"))
    event = lambda i: F.struct(
        F.col("started_at").alias("at"),
        F.lit("workflow_step").alias("key"),
        F.to_json(
            F.struct(
                i.alias("step_index"),
                F.lit("verify_claim").alias("skill"),
                (rid + i + 1).cast("string").alias("child_run_id"),
                F.when((rid + i) % 4 == 0, "error").otherwise("ok").alias("status"),
                F.when((rid + i) % 4 == 0, "Timeout: no answer").alias("error"),
                F.when(rid % 2 == 0, F.lit(True)).alias("fanout"),
            )
        ).alias("value"),
    )
    steps = F.when(rid % 3 == 0, F.transform(F.sequence(F.lit(0), (rid % 2 + 1).cast("int")), event)).otherwise(
        F.array().cast("array<struct<at:string,key:string,value:string>>")
    )
    returned = F.transform(
        F.sequence(F.lit(0), (rid % 4).cast("int")),
        lambda i: F.struct(
            F.concat(F.lit("c"), (rid + i).cast("string")).alias("chunk_id"),
            F.concat(F.lit("e"), ((rid + i) % 700).cast("string")).alias("evidence_id"),
            i.alias("rank"),
            F.round(-(rid % 17 + i) / 10, 6).alias("bm25_score"),
            F.lit(None).cast("string").alias("headings_path"),
            F.lit(None).cast("string").alias("evidence_title"),
        ),
    )
    method = F.when(rid % 6 == 0, "hybrid_rrf").otherwise("bm25")
    return (
        runs(spark, sf)
        .join(calls, "run_id", "left")
        .select(
            F.when(rid % 4 != 0, (rid % 4).cast("int")).alias("schema_version"),
            "run_id",
            F.lit("research").alias("directive"),
            "skill", "workspace", "corpus_version", "started_at", "status",
            inputs.alias("inputs"),
            F.when(rid % 2 == 0, F.map_concat(one("claim", F.concat(F.lit("claim "), rid.cast("string"))), one("k", rid % 20))).alias("effective_kwargs"),
            steps.alias("events"),
            F.struct(method.alias("method"), F.size(returned).cast("long").alias("candidates_considered"), returned.alias("returned")).alias("retrieval"),
            F.coalesce("calls", F.array().cast(_calls_type(calls))).alias("llm_calls"),
            F.when(F.col("status") == "ok", F.to_json(F.struct(label.alias("label"), F.repeat(F.concat(F.lit("claim "), rid.cast("string"), F.lit(" ")), (rid % 40).cast("int")).alias("claim")))).alias("output"),
        )
    )


def _calls_type(calls: DataFrame) -> str:
    return calls.schema["calls"].dataType.simpleString()


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), (F.col("vec_id") % 10 + 1).alias("corpus_version"), "embedding"
    )


def query_vecs(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector is also asked as a question."""
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _numbered_purchases(spark: SparkSession, sf: str) -> DataFrame:
    bought = load(spark, sf, "events").filter(F.col("event_type") == "purchase")
    return global_positions(bought.select("event_id", "ts", "value", "props"), ["event_id"], "idx")


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    params = (
        F.when(eid % 11 == 0, F.lit('{"path": 7, "content": "x"}'))
        .when(eid % 13 == 0, F.lit('{"content": "x"}'))
        .when(eid % 17 == 0, F.lit('{"path": "a.txt", "content": "x", "mode": "w"}'))
        .when(eid % 19 == 0, F.lit('{"path": "a.txt", "content": "x", "retries": true}'))
        .when(eid % 23 == 0, F.lit("not json"))
        .otherwise(F.concat(F.lit('{"path": "f'), eid.cast("string"), F.lit('.txt", "content": "x", "retries": 2}')))
    )
    return _numbered_purchases(spark, sf).select(
        eid.alias("approval_id"),
        "idx",
        F.concat(F.lit("ws"), (eid % 4).cast("string")).alias("workspace"),
        (eid % 2 + 1).cast("int").alias("approvers_required"),
        (eid * 3).alias("source_run_id"),
        iso(F.col("ts")).alias("created_at"),
        F.get(F.array(F.lit("fs.write_file"), F.lit("mail.send"), F.lit("shell.run")), (eid % 3).cast("int")).alias("executor"),
        params.alias("params"),
        F.when(F.col("idx") % 7 != 0, F.concat(F.lit("key"), (F.col("idx") % 1500).cast("string"))).alias("idempotency_key"),
        (eid % 29 != 0).alias("has_action"),
    )


def decisions(spark: SparkSession, sf: str, total: int) -> DataFrame:
    """Decision events aimed at one of ``total`` proposals by its idx (some at none)."""
    eid = F.col("event_id")
    word = F.when(F.col("event_type") == "error", "reject").when(eid % 101 == 0, "maybe").otherwise("accept")
    return (
        load(spark, sf, "events")
        .filter(F.col("event_type").isin("click", "view", "error"))
        .select(
            eid.alias("decision_id"),
            (eid % (total + 5) + 1).alias("idx"),
            word.alias("decision"),
            F.when(eid % 97 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("decided_by"),
            iso(F.col("ts")).alias("decided_at"),
            F.concat(F.lit("note "), eid.cast("string")).alias("note"),
        )
    )


def proposals_and_decisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with approval ids; a decision past the last proposal has an unknown id."""
    asked = proposals(spark, sf)
    made = decisions(spark, sf, asked.count())
    ids = asked.select("idx", "approval_id")
    made = made.join(unsent(ids), "idx", "left").withColumn("approval_id", F.coalesce("approval_id", -F.col("idx"))).drop("idx")
    return asked, made


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id")
    return load(spark, sf, "events").filter(F.col("event_type") == "signup").select(
        eid.alias("attempt_id"),
        (eid % 400 + 1).alias("idx"),
        (F.col("value") > 20).alias("ok"),
        iso(F.col("ts")).alias("at"),
        F.col("ts").alias("at_time"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Stored files: some lost, some altered."""
    return unversioned(spark, sf).filter(F.col("doc_id") % 50 != 0).select(
        F.col("source_path").alias("path"),
        F.when(F.col("doc_id") % 60 == 1, F.sha2(F.concat("text", F.lit("!")).cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"),
    )


def bad_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, some with an address that must be refused."""
    pid = F.col("page_id")
    url = (
        F.when(pid % 20 == 3, F.regexp_replace("url", "^https?", "ftp"))
        .when(pid % 20 == 5, F.regexp_replace("url", "^(https?://)", "$1user:pw@"))
        .when(pid % 20 == 7, F.lit("http://10.0.0.1/private"))
        .when(pid % 20 == 9, F.lit("http://169.254.169.254/latest"))
        .when(pid % 20 == 11, F.lit("https:///nohost"))
        .when(pid % 20 == 13, F.lit("http://[::1]/loop"))
        .when(pid % 20 == 15, F.lit("http://100.64.3.2/shared"))
        .otherwise(F.col("url"))
    )
    mime = F.when(pid % 20 == 17, "image/png").when(pid % 20 == 18, "application/pdf").otherwise("text/html")
    return load(spark, sf, "pages").select("page_id", url.alias("url"), F.col("html").alias("body"), mime.alias("mime_type"))


LABELS = schemas.LABELS
