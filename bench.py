"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.
Every query runs over its whole tables; rows go to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factloom.plans import catalog  # noqa: E402
from factloom.session import local_session  # noqa: E402

HEADLINE = [
    "token_counts",
    "chunk_sentences",
    "packed_chunks",
    "corpus_claims",
    "bm25_topk",
    "bm25_passages",
    "lexical_topk",
    "hashed_dense_topk",
    "weighted_fusion",
    "text_duplicates",
    "latest_supersession",
    "evidence_relations",
    "propagated_beliefs",
    "conflict_outcomes",
    "top_selection",
    "claim_answers",
    "answer_scores",
    "set_precision_recall",
    "metric_percentiles",
    "variant_seed_means",
    "threshold_grid",
    "paired_comparison",
    "dataset_issues",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # one small query starts the JVM code paths and the Python workers
    catalog.QUERIES["packed_chunks"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
