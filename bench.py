"""Times the headline queries: prints one JSON line with the warm median of each and their sum."""

from __future__ import annotations

import json
import os
import statistics
import time

from geofold.plans import catalog
from geofold.session import build_session

HEADLINE = [
    "terrain_classes", "tri", "slope_aspect", "flow_accumulation", "coast_distance", "way_geometry", "features_to_tiles",
    "points_in_polygons", "nearest_segment", "rasterize_polygons", "lww_register", "replay_order", "key_permissions",
    "parcel_lookup", "latest_key_record", "pack_merge", "section_top_n", "proximity_pairs", "tiered_top_k", "as_of_states",
    "rtt_median5", "column_runs", "dem_bilinear", "scalar_stats",
]
# Timed once, beside the headline total: bake passes, readers and streams.
MORE = ["engineered_ground", "channel_profile", "road_grade", "voxel_edits_apply", "read_dem_hgt", "position_smooth_batch", "stream_lww"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    for name in HEADLINE + MORE:
        taken = []
        for i in range((runs if name in HEADLINE else 1) + 1):  # the first run warms up
            start = time.perf_counter()
            df = queries[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
