"""Time the headline queries from a cold start of their own tables; print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from tidemark.session import build_session
from tidemark.staging import release
from workload import all_cases
from workload.views import forget_shared

HEADLINE = (
    "c8_densify_bars",
    "a4_daily_adjusted_returns",
    "a6_cumulative_return",
    "a10_momentum_signal",
    "a14_future_return_labels",
    "a16_rank_ic",
    "e6_lock_orders",
    "e7_admit_by_cash",
    "e8_fill_orders",
    "e10_fifo_match",
    "e12_replay_ledger",
    "e14_daily_nav",
    "j13_correction_anchor",
    "q1_quality_detail",
    "q10_listing_union",
    "q16_extract_notice_fields",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # One machine times itself here, so its own temporary folder serves as the shared one.
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    cases = all_cases()
    chosen = sys.argv[1:] or HEADLINE
    cases["c5_session_range"].spark(spark, sf_dir).count()  # JVM and session warm-up
    times: dict[str, float] = {}
    for name in chosen:
        # Every query builds what it needs from the base tables: nothing is shared between timings.
        forget_shared()
        release(spark)
        started = time.perf_counter()
        cases[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
