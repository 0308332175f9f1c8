"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkreel.plans import catalog  # noqa: E402
from sparkreel.session import build_session  # noqa: E402

HEADLINE = [
    "performance_correlations", "recommend_weights", "ab_test", "disagreements", "current_clips", "match_channel",
    "mock_scores", "virality_score", "is_non_verbal", "word_set", "read_subtitles", "clip_text", "top_clips", "even_sample",
    "nearest_line", "overlap_counts", "dedup_candidates", "refine_boundaries", "clamp_duration", "validate_clips",
    "chunk_timing", "render_event_text", "camera_qa", "growth_curve", "status_changes", "daily_window_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, sparkreel__document__partitions=cpus)
    queries = catalog.all_queries()
    # Start the JVM's code paths on a small read, so that the first query is not charged for them.
    queries["performance_correlations"](spark, sf_dir).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
