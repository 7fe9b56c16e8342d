"""Time the headline queries; prints one JSON line.

Each query is planned, run in full and written to a no-op sink.  The first run
of the session is a warm-up of the JVM and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dielens.plans.catalog import QUERIES
from dielens.session import session

HEADLINE = (
    "yield_by",
    "retest_gain",
    "bin_pareto",
    "wafer_summary",
    "evaluate_spec",
    "out_of_spec_rate",
    "parameter_summary",
    "capability",
    "correlation_matrix",
    "pat_limits",
    "spc_imr",
    "stacked_fail_map",
    "neighbour_fail_count",
    "publish_gate",
    "receipt_dedup",
    "detect_format",
    "unpivot_measurements",
    "version_history",
    "v_current_measurement",
    "trace_direct",
    "unit_wide_view",
    "page",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("yield_by")
    took = {name: run(name) for name in names}
    result = {
        "metric": "headline query seconds, total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf.rstrip("/")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
