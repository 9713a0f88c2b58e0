"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. A short warm-up
on a small projection starts the executors; every query is then run once to the end.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from spanwise.plans import catalog  # noqa: E402
from spanwise.plans.session import build_session, table  # noqa: E402

HEADLINE = (
    "experiment_grid",
    "ablation_behaviour",
    "fused_levels",
    "score_frames",
    "rolling_std_instability",
    "frame_runs",
    "event_level_summary",
    "timeline_merge",
    "window_summary",
    "interval_overlap_join",
    "greedy_match_metrics",
    "failure_pivot",
    "episode_bus",
    "strike_detector",
    "paired_permutation_exact",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, sf, "events").groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr)
    rows = table(spark, sf, "lineitem").count()
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf).name.removeprefix("sf"),
        "frame_scorings_per_sec": round(rows * 66 / times["experiment_grid"]),
        "reference_frame_scorings_per_sec": 42000,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
