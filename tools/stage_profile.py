"""Stage timings of one registered query from Spark's event log.

The event log is written to a fresh scratch folder (never the UI/REST
interface); per stage it prints duration, tasks, shuffle records written /
read, spilled bytes and summed executor run time.
usage: python tools/stage_profile.py <query> [sf_dir]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicpulse.plans.catalog import REGISTRY  # noqa: E402
from topicpulse.session import get_session  # noqa: E402


def _events(folder: str):
    for f in glob.glob(os.path.join(folder, "**", "events*"), recursive=True):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            yield json.loads(line)


def main() -> None:
    name = sys.argv[1]
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="topicpulse-eventlog-")
    spark = get_session("local[8]", app="topicpulse-profile", shuffle_partitions=8,
                        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                               "spark.driver.memory": "16g"})
    t0 = time.time()
    REGISTRY[name](spark, sf).write.format("noop").mode("overwrite").save()
    wall = time.time() - t0
    spark.stop()
    print(f"{name}: {wall:.1f}s wall; event log in {log_dir}")
    print("stage  secs  tasks  shuffle_w  shuffle_r  spill_MB  run_s")
    for e in _events(log_dir):
        if e.get("Event") != "SparkListenerStageCompleted":
            continue
        si = e["Stage Info"]
        acc = {a["Name"]: a.get("Value") for a in si.get("Accumulables", [])}
        secs = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
        print(f"{si['Stage ID']:5d} {secs:5.1f} {si['Number of Tasks']:6d} "
              f"{acc.get('internal.metrics.shuffle.write.recordsWritten') or 0:10} "
              f"{acc.get('internal.metrics.shuffle.read.recordsRead') or 0:10} "
              f"{(acc.get('internal.metrics.memoryBytesSpilled') or 0) / 1e6:9.0f} "
              f"{(acc.get('internal.metrics.executorRunTime') or 0) / 1000:6.1f}")


if __name__ == "__main__":
    main()
