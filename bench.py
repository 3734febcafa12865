"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or "all").
Every query is planned and run in full (results are discarded by the noop sink); the figure is the
median of BENCH_REPEAT runs (default 3) after a first one, which is reported on its own as "cold": it plans, compiles and
measures group sizes for the first time.
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

from laplens.plans import QUERIES  # noqa: E402
from laplens.session import build_session  # noqa: E402

HEADLINE = [
    "pace_table", "session_metrics", "race_pace_top_third", "tiers", "fast_slow_means", "quantile_bands", "gap_to_session_best",
    "within_107_percent", "runs_join_laps", "build_run_fact", "keep_last", "upsert", "run_pair_delta", "containment_join",
    "dictionary_tag_totals", "problem_solution", "pairwise_corr", "matrix_pivot", "asof_channel_value", "samples_in_laps",
    "moving_average_time", "local_minima_prominent", "greedy_min_gap", "island_stats", "decode_bundle", "job_run_dynamics",
    "job_corner_phases", "job_correlation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("OFF")
    times, cold = {}, {}
    for name in names:
        runs = []
        for _ in range(repeat + 1):
            t0 = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(runs[1:] or runs), 3)
        cold[name] = round(runs[0], 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": cold, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
