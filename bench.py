"""Time the headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadflow import catalog  # noqa: E402
from roadflow.session import build_session  # noqa: E402

HEADLINE = [
    "segment_speed_a3",
    "frame_rows_a6_w4",
    "frame_index_a10_w5",
    "vehicles_ahead_j2",
    "level_of_service_a1",
    "meters_driven_w1",
    "one_row_per_frame_p8_w3",
    "filled_frames_f10_j14",
    "segment_parts_a12",
    "interval_log_a15_w7",
    "status_at_completion_a18_w6",
    "enriched_frames_a22_j4",
    "combine_od_u1_j13_p14_f20",
    "segment_table_g12_f15_j11",
    "segment_state_g11_j10_t10",
    "route_times_a24_g6_p5",
    "assigned_behaviour_v18",
    "comparison_table_s28_c6",
]
# Iterative queries: many jobs in sequence, measured once.
ITERATIVE = [
    "stream_frame_rows_a8_v13",
    "roundabouts_g10",
    "nearest_nodes_j12",
    "distances_from_hub_g1",
    "k_shortest_streets_g2_g3_o4",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = os.environ.get("BENCH_ONLY", "")
    catalog.load()
    spark = build_session("roadflow-bench", cores=cores)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["segment_speed_a3"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE + ITERATIVE:
        if only and only not in name:
            continue
        taken = []
        for _ in range(runs if name in HEADLINE else 1):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(sorted(taken)[len(taken) // 2], 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores, "runs": runs,
    }))


if __name__ == "__main__":
    main()
