"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS],
fully materialised through the ``noop`` sink (every row and column computed, nothing
collected to the driver). One warm-up run, then the median of $BENCH_REPEATS runs.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from washline.plans.registry import QUERIES  # noqa: E402
from washline.session import get_session  # noqa: E402

HEADLINE = [
    "report_kpis",
    "service_leaderboard",
    "addon_leaderboard",
    "receipt_history",
    "fold_voids",
    "transaction_search",
    "sales_trend",
    "price_cart",
    "valid_window_join",
    "dq_unique",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session()
    times: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_wall",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
        "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
