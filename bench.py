"""Headline benchmark: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "scan_hids_jsonl",
    "scan_firewall_kv",
    "scan_windows_alert",
    "scan_windows_generic",
    "csv_hids_export",
    "archive_fallback_merge",
    "text_extract_ip",
    "fan_out_keys",
    "anchored_windows",
    "suppress_overlapping",
    "score_and_verdict",
    "incident_summary",
    "incident_timeline",
    "incident_value_list",
    "analyze_flagship",
]


def main() -> None:
    from emberwatch.session import local_session
    from workload.queries import REGISTRY, forget_shared

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "emberwatch-bench", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        forget_shared()  # every query pays for its own correlation
        began = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
