"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

A query starts with a fresh pipeline, so its time is that of the whole way
from the parquet scan; ``staged`` lists the time of a second run that reads
the stages the first one wrote.  Results are forced with the ``noop`` sink, so
nothing is collected to the driver.  ``$BENCH_REPEAT`` runs (default 1) are
taken per query and the median is reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["top_tags", "cooccur_weighted", "enrich_tweets", "clean_text", "tfidf",
            "cosine_pairs", "lda_sweep", "coherence_cv"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    from tagflow.plans.chain import Pipeline
    from tagflow.plans.registry import REGISTRY
    from tagflow.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})

    def run(name):
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - t0

    times, staged = {}, {}
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        fresh, again = [], []
        for _ in range(repeat):
            Pipeline.forget()
            fresh.append(run(name))
            again.append(run(name))
        times[name] = round(statistics.median(fresh), 3)
        staged[name] = round(statistics.median(again), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "staged": staged, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
