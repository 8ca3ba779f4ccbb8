"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

Each query is run to completion (noop sink, so the full plan executes and
nothing is collected to the driver); the reported time is the median of
``BENCH_REPEAT`` runs after one warm-up run of the flagship query.
Throughputs (statements/s through extraction -> scores, logged queries/s
through log -> impacts) are reported alongside.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ddlscope.plans import queries as Q  # noqa: E402
from ddlscope.session import build_session, read_table  # noqa: E402

HEADLINE = [
    "q_extract_ops",        # P1-P7 over every script
    "q_lock_lookup",        # L1-L4 with real row counts
    "q_migration_scores",   # P -> L -> R -> K end to end
    "q_rollback_summary",   # R1-R6
    "q_schema_changes",     # C + D
    "q_query_log",          # Q1-Q4
    "q_query_impacts",      # Q1-Q11 end to end
    "q_report_header",      # K6: everything per migration (scores, rollback, diff, impacts)
]


def _run(build) -> float:
    """Time building the plan and running it to completion."""
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in sys.argv[1:] if q in Q.QUERIES] or HEADLINE
    spark = build_session(master=f"local[{cpus}]")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    _run(lambda: Q.q_flagship(spark, sf_dir))  # warm-up (JVM, codegen caches)
    times = {}
    for name in only:
        runs = []
        for _ in range(repeat):
            spark.catalog.clearCache()
            runs.append(_run(lambda: Q.QUERIES[name](spark, sf_dir)))
        times[name] = round(statistics.median(runs), 3)

    n_statements = read_table(spark, sf_dir, "lineitem").count()
    n_events = read_table(spark, sf_dir, "events").count()
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": int(cpus),
        "statements_per_sec": round(n_statements / times["q_migration_scores"], 1)
        if "q_migration_scores" in times else None,
        "logged_queries_per_sec": round(n_events / times["q_query_impacts"], 1)
        if "q_query_impacts" in times else None,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
