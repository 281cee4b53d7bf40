"""Session construction and the shared scratch location.

On a cluster the scratch / checkpoint folder is whatever the deployment put
in ``spark.checkpoint.dir`` (a shared filesystem such as HDFS or an object
store).  Only a local master may go without it; a private folder is created
and registered then.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults tuned for correctness checks on one host; a cluster deployment
# passes its own values through ``extra`` or spark-submit.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Tables and lines that hold whole texts are stored compressed.
PARQUET_OPTIONS = {"compression": "zstd"}
# Files that several tasks share are cut into row groups of so many rows.
SPLIT_OPTIONS = {**PARQUET_OPTIONS, "parquet.block.row.count.limit": "4096"}
TEXT_OPTIONS = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def get_session(master: str | None = None, app: str = "topicpulse",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    # Ensure UTC even when the session already existed.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh sub-folder of the shared folder in ``spark.checkpoint.dir``.

    Only a local master may go without that setting (tests): there a private
    folder is created and registered.  Any other master without it raises,
    because each executor would write to its own disk.  The folder lives as
    long as the deployment keeps its checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="topicpulse-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    leaf = f"{name or 'run'}-{uuid.uuid4().hex[:12]}"
    return os.path.join(base.rstrip("/"), leaf)
