"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose tables and cores. Every query runs once to warm up and then
BENCH_RUNS times; the median counts. The whole result is computed, but written nowhere.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from pagesift.session import SETTINGS
from workload.queries import REGISTRY

HEADLINE = (
    "extract_matches",
    "extract_results",
    "extract_social",
    "extract_plaintext",
    "search_pages",
    "prepare_queries",
    "clean_result_urls",
    "cap_results",
    "url_filename",
    "fetch_dedup",
    "extract_pages",
    "validate_urls",
    "group_by_url",
    "build_report",
    "file_reports",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config(map=SETTINGS)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )

    def once(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in [n for n in HEADLINE if n in REGISTRY]:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus),
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
