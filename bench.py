"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is planned and run
to completion into a sink that discards rows, so all columns are computed. It runs twice
and the second run counts: at this size the first one measures how fast the JVM compiles.
"""

from __future__ import annotations

import json
import os
import sys
import time

import pyspark

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seasonframe.analog import QUERIES  # noqa: E402
from seasonframe.session import local_session  # noqa: E402

HEADLINE = [
    "q_season_totals", "q_weekly_status", "q_stat_sums", "q_absence_segments", "q_dedup_removed",
    "q_weighted_points", "q_diff_text", "q_diff_changed", "q_publish_plan", "q_category_plan",
    "q_market_trend", "q_fingerprint", "q_delta_guard", "q_name_match", "q_college_pivot",
    "q_listing_extract", "q_listing_cutoff", "q_upsert_plan", "q_upsert_forced", "q_remove",
    "q_dq_consistency", "q_dq_college", "q_dq_top10", "q_dq_membership", "q_dq_notes",
    "q_injury_match", "q_injury_weeks", "q_manifest_upsert",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold = {name: run(name) for name in names}
    seconds = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": cpus,
                "spark": pyspark.__version__,
                "cold_total": round(sum(cold.values()), 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
