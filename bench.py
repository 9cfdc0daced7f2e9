"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from kerbline.catalog import registry
from kerbline.session import build_session

HEADLINE = [
    "entry_accidents_per_link", "sjoin_nearest_max", "sjoin_within", "sjoin_within_buffer", "overlay_intersection", "buildings_in_zone",
    "win_pct_rank_avg", "win_decile_qcut", "agg_score_distribution", "road_risk_index", "road_facility_nearest", "walk_edge_safety",
    "track_classify", "gate_candidates", "students_allocate", "preference_state", "geo_to_crs", "src_json_records",
    "path_best_gate", "link_exposure",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["agg_count_by_key"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
