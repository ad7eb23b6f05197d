"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tests.session import local_session
from workload import QUERIES

HEADLINE = [
    "a04_lineitem",
    "a15_instrument",
    "p09_pred_or",
    "x02_log_linear",
    "x04_event_log_linear",
    "t05_point_scope",
    "t06_rollup_interval",
    "t11_expected",
    "v03_raw_value",
    "v05_batch",
    "v07_series_with_gaps",
    "l03_others",
    "h01_grid",
    "h11_normalize_rank",
    "h13_cell_details",
    "h15_column_percentile",
    "k03_percent_rate",
    "m_disk_disks_counters",
    "e04_latency",
    "e06_outermost",
    "e07_phases",
    "m_syscall_syscalls_events",
    "c11_choose_source",
    "u04_geolocate",
    "s08_restore_merge",
    "st01_tumbling",
    "st05_stateful_pairing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    QUERIES["a01_scalar_sum"](spark, sf_dir).collect()  # start the executors
    took: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
