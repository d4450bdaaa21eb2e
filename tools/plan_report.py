"""Print a one-line plan summary per registered query (exchanges, joins, Python
nodes, scans) from the executed physical plan -- a quick scale review."""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    from medialake.registry import queries
    from medialake.session import build_session
    spark = build_session()
    for name, fn in queries().items():
        if only and name not in only:
            continue
        df = fn(spark, sf_dir)
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString()
        counts = {k: len(re.findall(p, plan)) for k, p in {
            "xchg": r"Exchange ", "reused": r"ReusedExchange", "smj": r"SortMergeJoin",
            "bhj": r"BroadcastHashJoin", "bnlj": r"BroadcastNestedLoopJoin",
            "cart": r"CartesianProduct", "py": r"(ArrowEvalPython|FlatMapGroupsInPandas|BatchEvalPython)",
            "scan": r"FileScan|Scan parquet", "window": r"Window \[", "sort": r"Sort \["}.items()}
        flags = " ".join(f"{k}={v}" for k, v in counts.items() if v)
        print(f"{name:32s} {flags}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
