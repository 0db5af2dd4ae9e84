"""Headline queries, wall-clock, one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from qtospark.catalog import load_all  # noqa: E402
from qtospark.session import local_session  # noqa: E402

HEADLINE = [
    "trade_plaster", "trade_structure", "trade_screed", "trade_windows", "opening_schedule", "crosstab_wide",
    "measurement_protocol", "material_base", "material_bricks", "reconcile_counts", "double_check_numeric",
    "learned_factors", "correction_rules", "room_priority_merge", "room_plausibility", "severity_summary",
    "chain_sums", "wall_pairs", "label_values", "dashboard_kpis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executor threads
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        reg[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "headline_total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
