"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected) after one warm-up of the session.  Prints one JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}
plus documents/s of the summary methods.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from precis.plans import queries as Q  # noqa: E402
from precis.session import local_session  # noqa: E402

HEADLINE = (
    "summaries_tfidf",
    "summaries_textrank",
    "summaries_lead",
    "summaries_side_by_side",
    "clean_corpus",
    "html_to_text",
    "compare_models",
    "training_set",
    "summaries_hybrid",
    "training_metrics",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session(cpus, "precis-bench")
    qs = Q.queries()
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    # warm-up on the smallest fixture: JVM JIT, generated code, Python workers
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if os.path.isdir(warm_dir):
        for name in names:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    docs_per_s = {
        n: round(n_docs / t, 1) for n, t in times.items() if n.startswith("summaries_") and t > 0
    }
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "documents": n_docs,
        "documents_per_sec": docs_per_s,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
