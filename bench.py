"""Headline-query benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select the
data and the local parallelism.  Each query is run to completion once to warm the
JVM and land the derived tables, then timed twice; the better of the two runs is
reported (the result is consumed with a ``noop`` write, so every row is computed
without being collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "original_vs_copies", "duplicate_delete_list", "wasted_space", "library_stats",
    "top_resolutions", "raw_files", "outdated_videos", "suffix_with_original",
    "no_creation_date", "dir_rollup", "largest_dirs", "incremental_catalog_build",
    "album_by_resolution_plan", "date_from_name_plan",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from medialake.registry import queries
    from medialake.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    qs = queries()
    names = only or [n for n in HEADLINE if n in qs]
    times, errors = {}, {}
    for name in names:
        fn = qs[name]
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = None
            for _ in range(2):
                t0 = time.time()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.time() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as exc:  # noqa: BLE001 -- one failure must not hide the rest
            times[name] = None
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    total = round(sum(v for v in times.values() if v is not None), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total", "value": total, "unit": "sec",
           "queries": times, "sf": sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
