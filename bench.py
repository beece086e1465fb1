"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from attestor.plans import catalogue
from attestor.session import local_session

QUERIES = ("gate_verdict_counts", "triple_kb", "verify_triples", "chain_three_hop", "number_words", "sentence_split_naive", "wilson_by_source", "contaminated_quotes")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "10g", "bench")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in QUERIES:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
