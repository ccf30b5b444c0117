"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables, default /root/testdata/sf0.1
BENCH_CPUS     local cores, default 8
BENCH_QUERIES  comma list of names, or ``all``
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wayline.catalog import QUERIES  # noqa: E402
from wayline.session import local_session  # noqa: E402

HEADLINE = (
    "trips_gap_split", "trips_parking_cap", "trips_roll_up", "trips_movement_bridge", "trips_impossible_jump",
    "trips_touching_interval_pruned", "trip_statistics", "positions_interpolated", "fixes_heading",
    "gsensor_baselines", "gsensor_smoothed", "gsensor_overlap", "record_time_as_of", "search_text_substring",
    "search_near_points", "search_near_lines", "roads_in_boxes", "segments_speaker", "trip_merged_subtitles",
    "captions_merged", "sign_reads_parsed", "gps_log_parsed", "job_log_records", "run_log_lines",
    "locks_covering_requests", "archive_catalogue", "gpx_documents", "live_latest_position", "live_trips",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # warm up
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
