import json
import random

import pytest

from vouchspark.operators import approvals as A
from vouchspark.streaming import approvals as SA
from vouchspark.streaming import ingest as SI

PROPOSAL = "approval_id long, approvers_required int"
DECISION = "decision_id long, approval_id long, decision string, decided_by string, decided_at string, note string"


def event_rows(seed, n, hot):
    """A third of all decisions is on one approval."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        approval = hot if rng.random() < 0.34 else rng.randint(1, 40)
        word = rng.choices(["accept", "reject", "maybe"], [0.8, 0.1, 0.1])[0]
        who = rng.choice([None, "", *[f"u{j}" for j in range(12)]])
        rows.append((i, approval, word, who, f"2024-01-{rng.randint(1, 28):02d}", f"n{i}"))
    return rows


def replay(proposals, rows):
    """One decision after the other, as a person at the queue would see it."""
    status, accepts, voters, errors = {a: "pending" for a, _ in proposals}, {}, set(), {}
    required = dict(proposals)
    settled = {}
    for row in rows:
        i, approval, word, who, at, _ = row
        if word not in ("accept", "reject"):
            errors[i] = "invalid decision"
        elif not who:
            errors[i] = "decided_by required"
        elif approval not in status:
            errors[i] = "unknown approval"
        elif status[approval] != "pending":
            errors[i] = "already decided"
        elif (approval, who) in voters:
            errors[i] = "duplicate approver"
        else:
            voters.add((approval, who))
            accepts[approval] = accepts.get(approval, 0) + (word == "accept")
            if word == "reject" or accepts[approval] >= required[approval]:
                status[approval] = "rejected" if word == "reject" else "approved"
                settled[approval] = (at, who)
    return status, settled, errors


def test_fold_equals_one_by_one(spark):
    proposals = [(a, a % 4 + 1) for a in range(1, 36)] + [(99, 6)]
    rows = event_rows(1, 900, 99)
    p, d = spark.createDataFrame(proposals, PROPOSAL), spark.createDataFrame(rows, DECISION)
    status, settled, errors = replay(proposals, sorted(rows, key=lambda r: (r[4], r[0])))
    found = {r.approval_id: r for r in A.fold_decisions(p, d).collect()}
    assert {k: r.status for k, r in found.items()} == status
    assert {k: (r.decided_at, r.decided_by) for k, r in found.items() if r.decided_by} == settled
    judged = {r.decision_id: r.error for r in A.judged_decisions(p, d).collect()}
    assert {k: e for k, e in judged.items() if e} == errors and len(judged) == len(rows)
    assert A.decision_errors(p, d).count() == len(errors)
    for r in A.progress(p, d).collect():
        assert len(r.decisions) <= dict(proposals)[r.approval_id] + 1 and r.progress == f"{r.accept_count}/{dict(proposals)[r.approval_id]}"


def as_stream(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_stream_counts_in_order_of_arrival(spark, tmp_path):
    """Late decisions (earlier time, later arrival) do not change what was settled."""
    proposals = [(a, a % 3 + 1) for a in range(1, 36)]
    rows = event_rows(2, 240, 7)
    batches = [rows[:90], rows[90:170], rows[170:]]
    p = spark.createDataFrame(proposals, PROPOSAL)
    SA.stream_decisions(as_stream(spark, tmp_path / "in", batches, DECISION), p, str(tmp_path / "out")).awaitTermination()
    arrived = [r for b in batches for r in sorted(b, key=lambda r: (r[4], r[0]))]
    status, settled, errors = replay(proposals, arrived)
    found = {r.approval_id: r for r in SA.approval_status(spark, str(tmp_path / "out"), p).collect()}
    assert {k: r.status for k, r in found.items()} == status
    assert {k: (r.decided_at, r.decided_by) for k, r in found.items() if r.decided_by} == settled
    assert {r.decision_id: r.error for r in SA.decision_faults(spark, str(tmp_path / "out")).collect()} == errors


def test_repeated_batch_gives_the_same_tables(spark, tmp_path):
    """A batch that runs twice, as after a lost executor, leaves nothing behind twice."""
    p = spark.createDataFrame([(1, 2)], PROPOSAL)
    rows = [(1, 1, "accept", "a", "t1", ""), (2, 1, "accept", "a", "t2", ""), (3, 1, "accept", "b", "t3", "")]
    batch = spark.createDataFrame(rows, DECISION)
    for _ in range(2):
        SA.decision_batch(batch, 0, str(tmp_path), p)
    assert SA.approval_status(spark, str(tmp_path), p).first().status == "approved"
    assert [(r.decision_id, r.error) for r in SA.decision_faults(spark, str(tmp_path)).collect()] == [(2, "duplicate approver")]
    docs = spark.createDataFrame([(1, "x y", "s"), (2, "x y", "s")], "doc_id long, text string, source string")
    for number in (0, 0, 1):
        SI.ingest_batch(docs, number, str(tmp_path), target=10, overlap=0)
    assert [(r.doc_id, r.corpus_version) for r in SI.evidence_table(spark, str(tmp_path)).collect()] == [(1, 1)]
    assert SI.chunk_table(spark, str(tmp_path)).count() == 1


def test_attempts_equal_one_by_one(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, 5 if rng.random() < 0.34 else rng.randint(1, 30), rng.random() < 0.3, f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z") for i in range(300)]
    df = spark.createDataFrame(rows, "attempt_id long, approval_id long, ok boolean, at string").selectExpr("*", "to_timestamp(at) AS at_time")
    want = {}
    for _, approval, ok, at in rows:
        state, tries, _ = want.get(approval, ("pending", 0, None))
        if state == "pending":
            tries += not ok
            want[approval] = ("succeeded" if ok else "dead" if tries >= 3 else "pending", tries, at if ok else None)
    found = {r.approval_id: (r.exec_status, r.attempts, r.executed_at) for r in A.fold_attempts(df).collect()}
    assert found == want
    schema = "attempt_id long, approval_id long, ok boolean, at string, at_time timestamp"
    recorded = [tuple(r) for r in df.orderBy("attempt_id").collect()]
    stream = as_stream(spark, tmp_path / "in", [recorded[:100], recorded[100:110], recorded[110:]], schema)
    SA.stream_attempts(stream, str(tmp_path / "out")).awaitTermination()
    streamed = {r.approval_id: (r.exec_status, r.attempts, r.executed_at) for r in SA.execution_status(spark, str(tmp_path / "out")).collect()}
    assert streamed == want
    letters = sorted(r.approval_id for r in SA.dead_letters(spark, str(tmp_path / "out")).collect())
    assert letters == sorted(a for a, (state, *_) in want.items() if state == "dead")
    retry = A.fold_attempts(df.filter("attempt_id = 0")).first()
    assert retry.exec_status != "pending" or retry.next_retry_at == "2024-01-01T00:00:30.000Z"


SPEC = {
    "type": "object", "required": ["to"], "additionalProperties": False,
    "properties": {
        "to": {"type": "array", "items": {"type": "string"}}, "size": {"type": "number"}, "flag": {"type": "boolean"},
        "head": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "object", "required": ["k"]}}}},
    },
}


@pytest.mark.parametrize(
    "params, faults",
    [
        ({"to": ["a"], "size": 1.5, "flag": True}, []), ({"to": []}, []), ({}, ["params: missing required field to"]),
        ({"to": "a"}, ["params.to: expected array, got string"]), ({"to": ["a", 3]}, ["params.to[*]: expected string, got bigint"]),
        ({"to": [], "size": True}, ["params.size: expected number, got boolean"]), ({"to": [], "x": 1, "y": 2}, ["params: unexpected property x", "params: unexpected property y"]),
        ({"to": [], "head": {}}, ["params.head: missing required field id"]), ({"to": [], "head": {"id": 1.5}}, ["params.head.id: expected integer, got decimal"]),
        ({"to": [], "head": {"id": 3, "tags": [{"k": 1}, {}]}}, ["params.head.tags[*]: missing required field k"]), ([1], ["params: expected object, got array"]),
        ({"to": [], "size": None}, ["params.size: expected number, got void"]),
    ],
)
def test_parameter_rules(spark, params, faults):
    df = spark.createDataFrame([("mail.send", json.dumps(params))], "executor string, params string")
    assert A.validate_params(df, {"mail.send": SPEC}).first().violations == faults


def test_unknown_status_is_refused(spark):
    with pytest.raises(ValueError):
        A.list_approvals(spark.createDataFrame([], "approval_id long, status string, created_at string"), "done")


def test_leases(spark):
    approvals = spark.createDataFrame([(i, "approved" if i != 2 else "pending", i != 3, f"t{9 - i}") for i in range(9)], "approval_id long, status string, has_action boolean, created_at string")
    executions = spark.createDataFrame(
        [(4, "pending", "m", None), (5, "pending", "p", None), (6, "leased", None, "m"), (7, "leased", None, "l"), (8, "dead", None, None)],
        "approval_id long, exec_status string, next_retry_at string, lease_expires_at string",
    )
    assert [r.approval_id for r in A.leasable(approvals, executions, "m").collect()] == [7, 4, 1, 0]
