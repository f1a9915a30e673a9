"""Schemas of the stored tables and of the recorded trace document."""

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


WORKSPACE = table(
    ("workspace", STRING), ("schema_version", INT), ("created_at", STRING), ("embedding_model", STRING),
    ("corpus_version", LONG),
)
EVIDENCE = table(
    ("evidence_id", STRING), ("source_path", STRING), ("stored_path", STRING), ("sha256", STRING),
    ("mime_type", STRING), ("title", STRING), ("ingested_at", STRING), ("corpus_version", LONG),
)
CHUNK = table(
    ("chunk_id", STRING), ("evidence_id", STRING), ("seq", INT), ("text", STRING), ("token_count", INT),
    ("headings_path", STRING), ("start_offset", INT), ("end_offset", INT),
)
CHUNK_VECTOR = table(("chunk_id", STRING), ("corpus_version", LONG), ("embedding", T.ArrayType(T.FloatType())))
RUN = table(
    ("run_id", STRING), ("directive", STRING), ("skill", STRING), ("workspace", STRING), ("corpus_version", LONG),
    ("started_at", STRING), ("ended_at", STRING), ("status", STRING), ("model", STRING),
    ("total_input_tokens", LONG), ("total_output_tokens", LONG), ("total_cache_read", LONG),
    ("total_cache_creation", LONG), ("output_summary", STRING), ("error_message", STRING),
)
RUN_EVIDENCE = table(("run_id", STRING), ("chunk_id", STRING), ("role", STRING), ("rank", INT), ("score", DOUBLE))
APPROVAL = table(
    ("approval_id", STRING), ("workspace", STRING), ("directive", STRING), ("skill", STRING),
    ("source_run_id", STRING), ("status", STRING), ("summary", STRING), ("payload", STRING),
    ("proposed_action", STRING), ("approvers_required", INT), ("created_at", STRING), ("decided_at", STRING),
    ("decided_by", STRING), ("decision_note", STRING),
)
APPROVAL_DECISION = table(
    ("decision_id", STRING), ("approval_id", STRING), ("decision", STRING), ("decided_by", STRING),
    ("decided_at", STRING), ("note", STRING),
)
APPROVAL_EXECUTION = table(
    ("approval_id", STRING), ("exec_status", STRING), ("lease_owner", STRING), ("lease_expires_at", STRING),
    ("attempts", INT), ("idempotency_key", STRING), ("result", STRING), ("last_error", STRING),
    ("executed_at", STRING), ("next_retry_at", STRING),
)
GOLD_CLAIM = table(
    ("gold_id", STRING), ("workspace", STRING), ("claim", STRING), ("expected_label", STRING),
    ("corpus_version", LONG), ("relevant_chunk_ids", T.ArrayType(STRING)), ("source", STRING),
    ("source_run_id", STRING), ("note", STRING), ("added_at", STRING), ("added_by", STRING),
)
EVAL_RUN = table(("eval_id", STRING), ("workspace", STRING), ("created_at", STRING), ("config_json", STRING), ("metrics_json", STRING))
TIERED_POLICY = table(
    ("workspace", STRING), ("tier1_model", STRING), ("tier2_model", STRING), ("top_judge_model", STRING),
    ("escalation_threshold", DOUBLE), ("target", DOUBLE), ("calibrated_at", STRING),
    ("calibrated_against_eval_id", STRING), ("n_gold", LONG),
)
BENCHMARK_ITEM = table(
    ("id", STRING), ("passage", STRING), ("question", STRING), ("answer", STRING), ("label", STRING),
    ("source_ds", STRING),
)

LLM_CALL = table(
    ("call_id", STRING), ("model", STRING), ("input_tokens", LONG), ("output_tokens", LONG),
    ("cache_read_input_tokens", LONG), ("cache_creation_input_tokens", LONG), ("elapsed_ms", LONG),
)
EVENT = table(("at", STRING), ("key", STRING), ("value", STRING))
RETURNED = table(
    ("chunk_id", STRING), ("evidence_id", STRING), ("rank", INT), ("bm25_score", DOUBLE),
    ("headings_path", STRING), ("evidence_title", STRING),
)
RETRIEVAL = table(("method", STRING), ("candidates_considered", LONG), ("returned", T.ArrayType(RETURNED)))
STRING_MAP = T.MapType(STRING, STRING)
TRACE = table(
    ("schema_version", INT), ("run_id", STRING), ("directive", STRING), ("skill", STRING), ("workspace", STRING),
    ("corpus_version", LONG), ("started_at", STRING), ("ended_at", STRING), ("status", STRING), ("model", STRING),
    ("inputs", STRING_MAP), ("effective_kwargs", STRING_MAP), ("events", T.ArrayType(EVENT)),
    ("retrieval", RETRIEVAL), ("llm_calls", T.ArrayType(LLM_CALL)), ("output", STRING), ("error_message", STRING),
)

VERDICT = table(
    ("label", STRING), ("confidence", DOUBLE), ("reasoning", STRING), ("supporting_chunk_ids", T.ArrayType(STRING)),
    ("contradicting_chunk_ids", T.ArrayType(STRING)), ("missing_information", STRING),
)
BINARY_VERDICT = table(("faithful", BOOL), ("confidence", DOUBLE), ("reasoning", STRING))

# Closed vocabularies: fixed values.
LABELS = ("supported", "contradicted", "not_found", "partial")
APPROVAL_STATUSES = ("pending", "approved", "rejected", "expired")
TRACE_VERSIONS = (1, 2)
