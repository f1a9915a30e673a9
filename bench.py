"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.  One untimed run of the
flagship query comes first, so that the start of the JVM is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "new_documents", "corpus_versions", "word_chunks", "heading_sections", "inverted_index", "bm25_hits", "stored_index",
    "nearest_vectors", "fused_ranks", "verified_claims", "guarded_labels", "atom_votes", "calculation_rechecks", "run_rollup",
    "run_rollup_flat", "run_ancestry", "frozen_replay", "reliability_bins", "threshold_sweep", "evaluation_report",
    "decided_approvals", "judged_decisions", "folded_attempts", "invariant_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from vouchspark.plans import everything
    from vouchspark.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINES
    everything.QUERIES["verified_claims"](spark, folder).collect()
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        everything.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
