"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query runs
once to warm up code generation on the smallest data, then is timed on a full evaluation.
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterfold.plans.queries import QUERIES  # noqa: E402
from meterfold.session import local_session  # noqa: E402

HEADLINE = [
    "consumption_contained", "consumption_requests", "consumption_outcome",
    "measures_keep_latest", "rights_dedup", "registry_upsert_partial", "insert_if_absent",
    "lookup_batch", "list_page", "count_by_status", "dq_report",
    "validate_create_gas", "validate_patch_gas", "state_revoke_gas",
    "command_fold", "command_fold_elec", "recent_request", "accept_spaced",
    "mark_collected", "access_audit",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    timings = {}
    for name in names:
        if os.path.isdir(small):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(found.group(1)) if found else None,
    }))


if __name__ == "__main__":
    main()
