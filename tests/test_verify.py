import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vouchspark.functions.arithmetic import calculate
from vouchspark.functions.text import escape_markup, yes_no
from vouchspark.operators import judges as J
from vouchspark.operators import verify as V

REAL, OTHER, FAKE = "A" * 26, "B" * 26, "F" * 26
VERDICT = "claim_id long, mode string, label string, confidence double, reasoning string, supporting_chunk_ids array<string>, contradicting_chunk_ids array<string>, missing_information string"


def hits(spark, *claims):
    rows = [(c, REAL, 0) for c in claims] + [(c, OTHER, 1) for c in claims]
    return spark.createDataFrame(rows, "claim_id long, chunk_id string, rank long")


@pytest.mark.parametrize(
    "mode, label, sup, con, want",
    [
        ("evidence", "supported", [FAKE], [], "not_found"), ("evidence", "supported", [REAL, FAKE], [], "supported"),
        ("evidence", "contradicted", [REAL], [FAKE], "not_found"), ("judgment", "partial", [FAKE], [FAKE], "not_found"),
        ("evidence", "partial", [], [OTHER], "partial"), ("binary", "supported", [], [], "supported"), ("evidence", "not_found", [], [], "not_found"),
        ("evidence", "supported", None, None, "not_found"),
    ],
)
def test_guard(spark, mode, label, sup, con, want):
    df = spark.createDataFrame([(1, mode, label, 0.8, "r", sup, con, None)], VERDICT)
    row = V.guarded_verdicts(df, hits(spark, 1)).first()
    assert row.label == want and row.label_downgraded == (label != want) and row.confidence == 0.8
    assert FAKE not in row.supporting_chunk_ids + row.contradicting_chunk_ids
    assert row.dropped_chunk_ids == ([FAKE] if FAKE in (sup or []) + (con or []) else [])


def test_redaction_touches_only_unknown_ids(spark):
    long = FAKE + "X"
    text = f"{REAL} and {FAKE}, twice {FAKE}; not {long} nor {'i' * 26}"
    df = spark.createDataFrame([(1, "evidence", "supported", 1.0, text, [REAL], [], f"see {FAKE}")], VERDICT)
    row = V.guarded_verdicts(df, hits(spark, 1)).first()
    assert row.reasoning == f"{REAL} and [unverified-id], twice [unverified-id]; not {long} nor {'i' * 26}"
    assert row.missing_information == "see [unverified-id]"


def test_claim_without_hits_keeps_no_citation(spark):
    df = spark.createDataFrame([(7, "evidence", "supported", 1.0, "r", [REAL], [], None)], VERDICT)
    row = V.guarded_verdicts(df, hits(spark, 1)).first()
    assert row.label == "not_found" and row.supporting_chunk_ids == []


@pytest.mark.parametrize(
    "atoms, label, confidence",
    [
        ([("supported", 0.9), ("supported", 0.8)], "supported", 0.85), ([("supported", 0.9), ("not_found", 0.3)], "supported", 0.6),
        ([("supported", 0.0), ("not_found", 0.4)], "not_found", 0.2), ([("supported", 0.5), ("not_found", 0.5)], "partial", 0.5),
        ([("supported", None)], "supported", 0.5), ([("supported", None), ("not_found", 0.6)], "not_found", 0.6),
    ],
)
def test_votes(spark, atoms, label, confidence):
    df = spark.createDataFrame([(1, a, c) for a, c in atoms], "claim_id long, label string, confidence double")
    row = V.vote(df).first()
    assert row.label == label and round(row.confidence, 6) == confidence


def test_unknown_domain_fails_or_is_set_aside(spark):
    df = spark.createDataFrame([("clinical",), ("weather",)], "domain string")
    with pytest.raises(Exception, match="weather"):
        V.route_modes(df).collect()
    rows = V.route_modes(df, strict=False).collect()
    assert [r.route_error is None for r in rows] == [True, False]


@pytest.mark.parametrize(
    "answer, error",
    [
        (json.dumps({"label": "partial", "confidence": 1, "reasoning": "", "supporting_chunk_ids": [], "contradicting_chunk_ids": []}), None),
        ("nonsense", "not a JSON object"), ("[1]", "not a JSON object"), ("{}", "missing label"),
        (json.dumps({"label": "x", "confidence": 0.5, "reasoning": "", "supporting_chunk_ids": [], "contradicting_chunk_ids": []}), "unknown label"),
        (json.dumps({"label": "partial", "confidence": -0.1, "reasoning": "", "supporting_chunk_ids": [], "contradicting_chunk_ids": []}), "confidence outside 0..1"),
    ],
)
def test_parse(spark, answer, error):
    assert V.parse_verdicts(spark.createDataFrame([(1, answer)], "claim_id long, answer string")).first().parse_error == error


def test_tiers_follow_the_policy_of_the_workspace(spark):
    first = spark.createDataFrame([(1, "a", "supported", 0.6), (2, "b", "supported", 0.6), (3, "b", "not_found", 0.95)], "claim_id long, workspace string, label string, confidence double")
    second = spark.createDataFrame([(c, "partial", 0.7) for c in (1, 2, 3)], "claim_id long, label string, confidence double")
    policy = spark.createDataFrame([("a", 0.5)], "workspace string, escalation_threshold double")
    rows = sorted((r.claim_id, r.label, r.tier, r.escalated) for r in V.tiered_by_policy(first, second, policy).collect())
    assert rows == [(1, "supported", 1, False), (2, "partial", 2, True), (3, "not_found", 1, False)]


def test_decomposition(spark):
    df = spark.createDataFrame([(1, "One. Two! Three? Four. Five."), (2, "  "), (3, "Just one")], "claim_id long, claim string")
    found = {}
    for r in V.decompose(df).orderBy("claim_id", "atom_index").collect():
        found.setdefault(r.claim_id, []).append(r.atom)
    assert found == {1: ["One.", "Two!", "Three?", "Four. Five."], 2: ["  "], 3: ["Just one"]}
    plugged = V.decompose(df, lambda text: text.split(". ")[:2] if "One" in text else [])
    assert sorted((r.claim_id, r.atom) for r in plugged.collect()) == [(1, "One"), (1, "Two! Three? Four"), (2, "  "), (3, "Just one")]


def test_extraction_retries_and_reads_whole_documents(spark):
    """A cut answer is asked again; a hopeless one is an error row; the end of a long text is seen."""
    def extractor(text, budget):
        if "stubborn" in text:
            return ["half"], True
        if "long answer" in text:
            return ["full"], budget < 4096
        return ["end"] if "THE END" in text else [], False

    rows = [(1, "long answer"), (2, "stubborn"), (3, " \n "), (4, "x" * 450_000 + "THE END"), (5, "nothing")]
    found = V.extract_claims(spark.createDataFrame(rows, "doc_id long, text string"), extractor).collect()
    assert sorted((r.doc_id, r.claim, r.error is not None) for r in found if r.claim) == [(1, "full", False), (4, "end", False)]
    assert [r.doc_id for r in found if r.error] == [2]
    assert [r.part for r in found if r.doc_id == 4] == [2]


def test_requests_end_at_sentences(spark):
    claim = "The claim across the bound stays whole."
    text = "a. " * 66_660 + claim + " b." * 80_000
    whole = V.extract_claims(spark.createDataFrame([(1, text)], "doc_id long, text string"), lambda t, _: ([claim] if claim in t else [], False)).collect()
    assert [(r.claim, r.part) for r in whole] == [(claim, 1)]
    for text, parts in (
        ("", [""]), ("ab. cd. ef.", ["ab. cd.", " ef."]), ("ab cd ef gh", ["ab cd ef", " gh"]), ("ab cd efg h", ["ab cd", " efg h"]), ("x" * 18, ["x" * 8, "x" * 8, "xx"]),
        (" " + "y" * 16, [" " + "y" * 7, "y" * 8, "y"]), (" " * 18, [" " * 8, " " * 8, "  "]), ("aaaaaaa. b", ["aaaaaaa.", " b"]),
    ):
        assert V.request_parts(text, 8) == parts and "".join(parts) == text


def test_topics(spark):
    topics = spark.createDataFrame([(1, "known"), (2, "silent")], "topic_id long, topic string")
    found = hits(spark, 1).withColumn("text", F.lit("body")).withColumn("evidence_title", F.lit("a<b")).withColumn("headings_path", F.lit(None).cast("string"))

    def writer(frame):
        points = [[{"point": "kept", "supporting_chunk_ids": [REAL, FAKE]}, {"point": "dropped", "supporting_chunk_ids": [FAKE]}]] * len(frame)
        return pd.DataFrame({"topic_id": frame["topic_id"], "summary": frame["corpus"], "key_points": points, "gaps": [None] * len(frame)})

    rows = {r.topic_id: r for r in V.research_topics(topics, found, writer).collect()}
    assert [p.point for p in rows[1].key_points] == ["kept"] and rows[1].supporting_chunk_ids == [REAL]
    assert rows[1].summary.startswith(f'<corpus>\n<chunk id="{REAL}" source="a&lt;b" headings="">\nbody\n</chunk>')
    assert rows[2].summary == V.SILENT_SUMMARY and rows[2].key_points == []


@pytest.mark.parametrize(
    "expression, result",
    [
        ("1+2", "3"), ("10/4", "2.5"), ("10//3", "3"), ("2**8", "256"), ("-(5)", "-5"), ("1234.5 / 8000 * 100", "15.4312"), ("0.1+0.2", "0.3"),
        ("1/0", "ERROR: division by zero"), ("2**65", "ERROR: exponent too large (max abs 64)"), ("", "ERROR: expression must be a non-empty string"),
        ("True+1", "ERROR: only numeric literals allowed, got bool"), ("1e999", "ERROR: result is not a finite number"),
        ("(-8)**0.5", "ERROR: result is not a real number"), ("x+1", "ERROR: AST node not allowed: Name"), ("1 & 2", "ERROR: operator not allowed: BitAnd"),
        ("~1", "ERROR: unary operator not allowed: Invert"), ("1" * 257, "ERROR: expression too long (max 256 chars)"),
    ],
)
def test_calculator(expression, result):
    assert calculate(expression) == result


def test_tool_calls_of_traces(spark):
    value = json.dumps({"tool": "calculate", "input": {"expression": "2*3"}, "result": "7", "elapsed_ms": 1})
    df = spark.createDataFrame([(1, [("t", "tool_call_0", value), ("t", "other", "{}")])], "run_id long, events array<struct<at:string,key:string,value:string>>")
    row = V.calculation_faults(V.recheck_calculations(V.tool_calls(df))).first()
    assert (row.calls, row.disagreements, row.mismatch_rate) == (1, 1, 1.0)


def test_yes_no_and_escaping(spark):
    texts = ["Yes, sure", "  NO.", "**yes**", "I know", "maybe", "Nothing but yes"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(yes_no(F.col("t"))).collect()] == ["PASS", "FAIL", "PASS", "FAIL", "", "FAIL"]
    assert spark.createDataFrame([("<a href='x'>\"&\"</a>",)], "t string").select(escape_markup(F.col("t"))).first()[0] == "&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;&quot;&lt;/a&gt;"


def test_lexical_judge_labels(spark):
    claims = spark.createDataFrame([(1, "red green blue black"), (2, "red one two three"), (3, "none here at all")], "claim_id long, claim string")
    found = spark.createDataFrame([(c, REAL, "Red green blue") for c in (1, 2, 3)], "claim_id long, chunk_id string, text string")
    rows = {r.claim_id: (r.label, r.confidence, r.supporting_chunk_ids) for r in J.lexical_judge(claims, found).collect()}
    assert rows == {1: ("supported", 0.75, [REAL]), 2: ("partial", 0.25, [REAL]), 3: ("not_found", 0.0, [])}
