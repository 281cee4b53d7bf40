"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed in full with the no-op sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicpulse.plans.catalog import REGISTRY  # noqa: E402
from topicpulse.session import get_session  # noqa: E402

HEADLINE = [
    "report_topic", "report_all_topics", "bucket_metrics",
    "timeline_1w_3m", "summary_this_month", "kpis", "daily_sentiment",
    "match_cnf_narrow", "match_cnf_inverted", "match_since_48h", "limit_per_topic",
    "normalize_posts", "event_json_roundtrip", "sentiment_lexicon",
    "current_posts_merge", "latest_rows", "append_topics", "tasks_with_topic",
    "top_keywords", "topic_filters", "stream_enrich", "stream_upsert", "topic_trends",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app="topicpulse-bench",
                        shuffle_partitions=max(8, cpus),
                        extra={"spark.driver.memory": "16g"})
    # Warm-up: JVM, parquet footers, Python workers.
    REGISTRY["kpis"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        t0 = time.time()
        try:
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 — record the failure, keep benchmarking
            print(f"bench: {name} failed: {e}", file=sys.stderr)
            times[name] = None
    m = re.search(r"sf([0-9.]+)", sf_dir)
    done = [v for v in times.values() if v is not None]
    print(json.dumps({"metric": "headline_total", "value": round(sum(done), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
