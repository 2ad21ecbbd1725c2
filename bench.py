"""Wall time of the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the input and the cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "top_talkers_src_bytes", "top_talkers_dst_flows_5m", "top_ports_dst", "protocols_bytes", "search_range", "search_cidr", "tier_5m_talkers", "tier_1h_ports",
    "metric_history", "metric_rollup", "histogram_percentile", "nearest_rank_p95", "gap_fill", "log_search", "dedup_first_wins", "zeek_parse", "rest_normalize", "netflow5_decode",
    "v9_decode", "dashboard_series",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from pyspark.sql import SparkSession

    from weirflow import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = queries.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # the first run warms up
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
