"""Streams run to the end over the given tables, and what they leave behind.

The tables are first written in parts to the shared folder, so that a stream sees several
micro-batches; every result equals the batch job's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vouchspark.operators import retrieval as R
from vouchspark.plans import derived as D
from vouchspark.plans.registry import query
from vouchspark.plans.retrieval_queries import STEMMED_SQL
from vouchspark.session import checkpoint_root
from vouchspark.streaming import approvals as SA
from vouchspark.streaming import ingest as SI
from vouchspark.streaming import keyed as SK
from vouchspark.streaming.tables import remove_folders


def _root(spark) -> str:
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def _run_parts(spark, df, root: str, parts: int, start) -> None:
    """Feed ``df`` part by part to one stream: a part is added to its input folder, the stream
    takes what is there and stops, and goes on from its checkpoint with the next part.  The parts
    are written once, by as many tasks as the table has, and a part goes once the stream has it."""
    df.write.partitionBy("_part").parquet(f"{root}/staged")
    staged, schema = spark.read.parquet(f"{root}/staged"), df.drop("_part").schema
    for part in range(parts):
        staged.filter(F.col("_part") == part).drop("_part").write.mode("append").parquet(f"{root}/input")
        remove_folders(spark, [f"{root}/staged/_part={part}"])
        start(spark.readStream.schema(schema).parquet(f"{root}/input")).awaitTermination()


@query("""
    SELECT f.sha256, count(DISTINCT c.chunk_id) AS chunks, true AS one_version_each FROM first_docs f LEFT JOIN ch c ON c.sha256 = f.sha256 GROUP BY 1""")
def streamed_corpus(spark, sf):
    """Documents ingested batch by batch; copies are dropped against all history."""
    root = _root(spark)
    docs = D.documents(spark, sf).select("doc_id", "text", "source").withColumn("_part", (F.col("doc_id") % 3).cast("int"))
    _run_parts(spark, docs, root, 3, lambda stream: SI.stream_ingest(stream, root, target=D.TARGET, overlap=D.OVERLAP, buckets=16))
    return _one_version_each(spark, root)


@query("""
    SELECT f.sha256, count(DISTINCT c.chunk_id) AS chunks, true AS one_version_each FROM first_docs f LEFT JOIN ch c ON c.sha256 = f.sha256 GROUP BY 1""")
def compacted_corpus(spark, sf):
    """The same with the tables compacted between the runs of the stream."""
    root = _root(spark)
    docs = D.documents(spark, sf).select("doc_id", "text", "source").withColumn("_part", (F.col("doc_id") % 3).cast("int"))

    def start(stream):
        SI.compact_corpus(spark, root)
        return SI.stream_ingest(stream, root, target=D.TARGET, overlap=D.OVERLAP, buckets=16)

    _run_parts(spark, docs, root, 3, start)
    SI.compact_corpus(spark, root)
    return _one_version_each(spark, root)


def _one_version_each(spark, root):
    evidence, chunks = SI.evidence_table(spark, root), SI.chunk_table(spark, root)
    per_document = chunks.groupBy("sha256").agg(F.count_distinct("chunk_id").alias("chunks"))
    versions = evidence.groupBy("corpus_version").agg(F.count(F.lit(1)).alias("n"))
    joined = evidence.join(versions, "corpus_version").join(per_document, "sha256", "left")
    return joined.select("sha256", F.coalesce("chunks", F.lit(0)).alias("chunks"), (F.col("n") == 1).alias("one_version_each"))


@query("SELECT query_id, chunk_id, rank, score FROM ranked WHERE rank < 10")
def streamed_index(spark, sf):
    """An index grown batch by batch answers like one built at once."""
    root = _root(spark)
    chunks = D.ch(spark, sf).select("chunk_id", "corpus_version", "text").withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(2)).cast("int"))
    _run_parts(spark, chunks, root, 2, lambda stream: SI.stream_index(stream, root, buckets=8))
    return R.bm25_topk(D.questions(spark, sf), R.read_index(spark, root), 10)


@query("SELECT claim_id AS query_id, chunk_id, rank, score FROM hits")
def stored_index(spark, sf):
    """An index written once and read back for a batch of questions."""
    root = _root(spark)
    R.write_index(R.build_index(D.ch(spark, sf)), root, buckets=16)
    return R.bm25_topk(D.questions(spark, sf), R.read_index(spark, root), 10)


@query(STEMMED_SQL)
def stored_stemmed_index(spark, sf):
    """A stored index of stems, made once per word of its vocabulary, grown by a second
    batch and compacted to one."""
    root, chunks = _root(spark), D.stored_ch(spark, sf)
    for part in range(2):
        own = chunks.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == part)
        R.write_index(R.build_index(own, stem=True), f"{root}/parts", buckets=8, batch=part)
    R.compact_index(spark, f"{root}/parts", f"{root}/whole")
    return R.bm25_topk(D.questions(spark, sf), R.read_index(spark, f"{root}/whole"), 10)


def _in_order(df, column: str, parts: int):
    """Cut a table into consecutive parts of its time column."""
    cuts = df.agg(F.percentile_approx(F.to_timestamp(column).cast("double"), [i / parts for i in range(1, parts)], 1000).alias("c")).first()["c"]
    moment = F.to_timestamp(column).cast("double")
    part = sum((F.when(moment > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    return df.withColumn("_part", part.cast("int"))


def _decided(spark, sf):
    root = _root(spark)
    asked, made = D.proposals_and_decisions(spark, sf)
    asked.write.parquet(f"{root}/proposals")
    asked = spark.read.parquet(f"{root}/proposals")
    made.select("decision_id", "approval_id", "decision", "decided_by", "decided_at", "note").write.parquet(f"{root}/decisions")
    _run_parts(spark, _in_order(spark.read.parquet(f"{root}/decisions"), "decided_at", 3), root, 3, lambda stream: SA.stream_decisions(stream, asked, root))
    return root, asked


@query("SELECT approval_id, status, decided_at, decided_by FROM folded")
def streamed_decisions(spark, sf):
    """Status after a stream of decisions."""
    root, asked = _decided(spark, sf)
    return SA.approval_status(spark, root, asked).select("approval_id", "status", "decided_at", "decided_by")


@query("""
    SELECT d.decision_id, CASE WHEN d.decision = 'maybe' THEN 'invalid decision' WHEN d.decided_by IS NULL THEN 'decided_by required'
             WHEN d.approvers_required IS NULL THEN 'unknown approval'
             WHEN (d.decided_at, d.decision_id) > (t.decided_at, t.decision_id) THEN 'already decided' ELSE 'duplicate approver' END AS error
    FROM decisions d LEFT JOIN terminal t ON t.approval_id = d.approval_id LEFT JOIN first_votes f ON f.approval_id = d.approval_id AND f.decided_by = d.decided_by
    WHERE d.decision = 'maybe' OR d.decided_by IS NULL OR d.approvers_required IS NULL OR (d.decided_at, d.decision_id) > (t.decided_at, t.decision_id) OR d.decision_id <> f.decision_id""")
def streamed_decision_faults(spark, sf):
    """The error output of the same stream."""
    root, _ = _decided(spark, sf)
    return SA.decision_faults(spark, root).select("decision_id", "error")


@query("""
    WITH win AS (SELECT * FROM attempts WHERE ok QUALIFY row_number() OVER (PARTITION BY approval_id ORDER BY tried, attempt_id) = 1),
    lost AS (SELECT a.approval_id, a.at_time, row_number() OVER (PARTITION BY a.approval_id ORDER BY a.tried, a.attempt_id) AS n FROM attempts a LEFT JOIN win w ON w.approval_id = a.approval_id
             WHERE NOT a.ok AND (w.tried IS NULL OR (a.tried, a.attempt_id) < (w.tried, w.attempt_id))),
    f AS (SELECT approval_id, count(*) AS attempts FROM lost WHERE n <= 3 GROUP BY 1)
    SELECT i.approval_id, coalesce(f.attempts, 0) AS attempts, CASE WHEN f.attempts >= 3 THEN 'dead' WHEN w.tried IS NOT NULL THEN 'succeeded' ELSE 'pending' END AS exec_status,
           coalesce(f.attempts >= 3, false) AS dead_letter
    FROM (SELECT DISTINCT approval_id FROM attempts) i LEFT JOIN f ON f.approval_id = i.approval_id LEFT JOIN win w ON w.approval_id = i.approval_id""")
def streamed_attempts(spark, sf):
    """Execution state and dead letters after a stream of attempts."""
    root = _root(spark)
    tries = D.attempts(spark, sf).join(D.proposals(spark, sf).select("idx", "approval_id"), "idx")
    tries.select("attempt_id", "approval_id", "ok", "at", "at_time").write.parquet(f"{root}/tries")
    _run_parts(spark, _in_order(spark.read.parquet(f"{root}/tries"), "at", 3), root, 3, lambda stream: SA.stream_attempts(stream, root))
    letters = SA.dead_letters(spark, root).select("approval_id", F.lit(True).alias("dead_letter"))
    found = SA.execution_status(spark, root).join(letters, "approval_id", "left")
    return found.select("approval_id", "attempts", "exec_status", F.coalesce("dead_letter", F.lit(False)).alias("dead_letter"))


@query("SELECT approval_id, status, decided_at, decided_by FROM folded")
def keyed_decisions(spark, sf):
    """Status from keyed state, the stream stopped and started again after every part."""
    root = _root(spark)
    asked, made = D.proposals_and_decisions(spark, sf)
    asked.write.parquet(f"{root}/proposals")
    asked = spark.read.parquet(f"{root}/proposals")
    made.select("decision_id", "approval_id", "decision", "decided_by", "decided_at", "note").write.parquet(f"{root}/decisions")

    def start(stream):
        SK.stream_votes(stream, asked, root).awaitTermination()
        return SK.keyed_status(SK.votes_stream(spark, root), root)

    _run_parts(spark, _in_order(spark.read.parquet(f"{root}/decisions"), "decided_at", 3), root, 3, start)
    return SK.settled_status(spark, root, asked).select("approval_id", "status", "decided_at", "decided_by")


#: Seconds until the next try; the odd millisecond keeps a due time apart from any attempt's.
ALARM_BACKOFF = 21600.001


@query(f"""
    WITH a AS (SELECT approval_id, attempt_id, ok, epoch_us(at_time) // 1000 AS tick FROM attempts),
    t AS (SELECT approval_id, tick, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS failures, max(CAST(ok AS INTEGER)) OVER w AS won, lead(tick) OVER w AS next_at
          FROM a WINDOW w AS (PARTITION BY approval_id ORDER BY tick, attempt_id)),
    u AS (SELECT *, tick + {round(ALARM_BACKOFF * 1000)} AS later FROM t WHERE won = 0 AND failures <= 3),
    m AS (SELECT max(tick) - 3600000 AS mark FROM a)
    SELECT approval_id, CASE WHEN failures = 3 THEN 'dead' ELSE 'retry' END AS alarm, CAST(failures AS BIGINT) AS failures, CASE WHEN failures = 3 THEN tick ELSE later END AS due_ms
    FROM u, m WHERE failures = 3 OR next_at > later OR (next_at IS NULL AND later <= mark)""")
def due_retries(spark, sf):
    """Retries that came due and dead letters, told by event-time timers."""
    root = _root(spark)
    tries = D.attempts(spark, sf).join(D.proposals(spark, sf).select("idx", "approval_id"), "idx")
    tries.select("attempt_id", "approval_id", "ok", "at", "at_time").write.parquet(f"{root}/tries")
    parts = _in_order(spark.read.parquet(f"{root}/tries"), "at", 3).drop("at")
    _run_parts(spark, parts, root, 3, lambda stream: SK.stream_alarms(stream, root, backoff=ALARM_BACKOFF))
    return SK.alarm_table(spark, root).select("approval_id", "alarm", "failures", F.unix_millis("due").alias("due_ms"))
