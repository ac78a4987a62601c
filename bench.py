"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from reelwright.session import local_session
from verification.all import queries

HEADLINE = (
    "provider_index", "duplicate_edges", "connected_components", "select_keep_delete", "delete_safe",
    "rate_items", "movie_cleanup", "series_cleanup", "any_user_status", "compare_copies", "title_pairs",
    "missing_stats", "series_completeness", "franchise_gaps", "fix_genres", "propose_updates",
    "playback_sessions", "yoy_overview", "series_facts", "inventory_upsert", "debounce_batches",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    table = queries()
    # Warm the JVM on the smallest tables, so that the first timings are not class loading.
    small = os.path.join(os.path.dirname(os.path.normpath(sf_dir)), "sf0.001")
    for name in ("select_keep_delete", "playback_sessions"):
        table[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        table[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
