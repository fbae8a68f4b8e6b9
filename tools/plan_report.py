"""Summarise the physical plans of the headline queries.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

For each query (run once first, so its inputs are staged): the parquet
scans with their pushed filters and read schema, and counts of exchanges,
reused exchanges, join strategies, aggregates and windows in the static
physical plan.  Stages read back from the shared folder appear as parquet scans
with the columns that the query reads of them.
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = ["scan_tweets", "filter_lang", "top_tags", "cooccur_weighted", "enrich_tweets", "clean_text", "tfidf", "cosine_pairs",
           "soft_cosine_pairs", "mine_bigrams", "apply_bigrams", "coherence_terms", "topic_relevance"]

NODES = ["Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window",
         "TakeOrderedAndProject", "Scan parquet", "Scan ExistingRDD", "ReusedExchange"]


def summarize(plan: str) -> str:
    counts = collections.Counter()
    scans = set()
    for line in plan.splitlines():
        if "ReusedExchange" in line:
            counts["ReusedExchange"] += 1
            continue
        for n in NODES:
            if re.search(r"[+:\- ]" + re.escape(n) + r"\b", line) or line.strip().startswith(n):
                counts[n] += 1
        m = re.search(r"FileScan (\w+)", line)
        if m:
            loc = re.search(r"\[file:([^\],]+)", line)
            pf = re.search(r"PushedFilters: (\[.*?\])", line)
            rs = re.search(r"ReadSchema: (struct<.*?>)", line)
            scans.add(f"- {m.group(1)} `{os.path.basename(loc.group(1).rstrip('/')) if loc else '?'}` "
                      f"PushedFilters={pf.group(1) if pf else '[]'} ReadSchema=`{rs.group(1) if rs else ''}`")
            counts[f"Scan {m.group(1)}"] += 1
    out = ["| node | count |", "|---|---|"] + [f"| {k} | {v} |" for k, v in sorted(counts.items())]
    return "\n".join(sorted(scans)) + "\n\n" + "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from tagflow.plans.registry import REGISTRY
    from tagflow.session import build_session

    spark = build_session()
    print(f"# Physical plans of the headline queries ({sf}, local[8])\n")
    print("Generated by `tools/plan_report.py`. Counts are of the static physical plan of each query")
    print("(AQE re-plans at run time, e.g. sort-merge to broadcast from measured sizes); earlier stages")
    print("it reads from the shared folder show up as parquet scans.\n")
    for name in QUERIES:
        df = REGISTRY[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        # The static plan (AQE off, for printing only) shows exchange reuse
        # and the planner's join choices before run-time re-planning.
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        print(f"## {name}\n")
        print(summarize(plan))
        print()
    spark.stop()


if __name__ == "__main__":
    main()
