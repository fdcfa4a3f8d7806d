"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores. Shared stages are forgotten
before every query, so each time includes everything the query needs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from firespark import catalog  # noqa: E402
from firespark.catalog import stages  # noqa: E402
from firespark.session import build_session  # noqa: E402

HEADLINE = (
    "confidence_filter", "mask_anti_join", "spatial_dedup", "persistent_sources", "clip_to_territory",
    "fire_assignment", "fire_rollup", "report_match", "incidents", "wind_idw", "warnings_worst_wins",
    "closures_radius_count", "nearest_settlement", "growth_recent_hotspots", "land_cover",
    "invariant_violations", "severity_ranking", "asset_exposure", "hotspot_filter", "daily_evolution",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    # One small read first: starting the JVM is not part of any query.
    spark.read.parquet(f"{sf}/events.parquet").limit(1).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        stages.clear()
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    # The whole chain once, with its stages stored as a scheduled run stores them.
    stages.clear()
    start = time.perf_counter()
    catalog.QUERIES["context_composed"](spark, sf).write.format("noop").mode("overwrite").save()
    times["full_chain"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": Path(sf).name,
            }
        )
    )


if __name__ == "__main__":
    main()
