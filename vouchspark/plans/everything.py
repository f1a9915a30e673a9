"""All registered queries."""

from vouchspark.plans import (  # noqa: F401
    approval_queries,
    audit_queries,
    corpus_queries,
    evaluate_queries,
    job_queries,
    retrieval_queries,
    run_queries,
    source_queries,
    stream_queries,
    verify_queries,
)
from vouchspark.plans.registry import QUERIES, SQL  # noqa: F401
