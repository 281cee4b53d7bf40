"""The trend report kept up to date batch by batch, without rescanning the log.

Three tables under one folder, each with one ``batch=<n>`` folder per
micro-batch, overwritten when the batch is replayed:

* ``state``    - the merged newest version of every post of the days that the
  batch touches, by ``day``;
* ``partials`` - those days' sums per topic (one row per topic and day);
* ``report``   - optional: the gap-filled report after the batch.

A batch of re-sent posts reads the state of its own days only (partition
pruning to each day's newest folder), takes the old versions out and the new
ones in by the keyed merge (D1: each field's newest non-null value), and
replaces those days' partials.  Everything else is left as it is, so a cycle
costs what its look-back window holds, however long the log has become.  A
batch reads only folders of lower batches, hence a replay gives the same rows.

A post's creation time is part of its identity: a version that moves it to
another day counts there as another post.  Rows without key or time are left
out.
"""

from __future__ import annotations

import datetime as _dt
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicpulse.operators.metrics import day_partials, report_from_days
from topicpulse.operators.state import KEYS, current_posts

VALUES = ("created_at", "engagement", "sentiment_score")
_STATE = ("topic_id string, event_id string, created_at timestamp, engagement int, "
          "sentiment_score double")
_PARTIALS = "topic_id string, day timestamp, mentions long, engagement long, sentiment_sum double"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _table(spark: SparkSession, path: str, name: str, ddl: str, parts: str) -> DataFrame | None:
    where = os.path.join(path, name)
    return spark.read.schema(f"{ddl}, {parts}").parquet(where) if _exists(spark, where) else None


def old_versions(spark: SparkSession, path: str, days: list[_dt.date], batch_id: int) -> DataFrame | None:
    """The stored posts of ``days`` as of the batches before ``batch_id``."""
    partials = _table(spark, path, "partials", _PARTIALS, "batch int")
    if partials is None or not days:
        return None
    date = F.to_date("day")
    newest = (partials.where((F.col("batch") < batch_id) & date.isin(days))
              .groupBy(date.alias("day")).agg(F.max("batch").alias("batch")).collect())  # a row per day
    if not newest:
        return None
    held = reduce(lambda a, b: a | b, [(F.col("batch") == r["batch"]) & (F.col("day") == F.lit(r["day"]))
                                       for r in newest])
    return _table(spark, path, "state", _STATE, "batch int, day date").where(held).drop("batch", "day")


def apply_batch(batch: DataFrame, batch_id: int, path: str, as_of: _dt.datetime | None = None) -> None:
    """Merge one micro-batch of post versions (``KEYS``, ``VALUES``); see the module."""
    spark = batch.sparkSession
    new = batch.select(*KEYS, *VALUES).where("created_at IS NOT NULL").persist()
    try:
        days = [r[0] for r in new.select(F.to_date("created_at")).distinct().collect()]
        versions = new.select("*", F.lit(1).alias("newer"), F.monotonically_increasing_id().alias("nth"))
        old = old_versions(spark, path, days, batch_id)
        if old is not None:
            versions = versions.unionByName(old.select(
                "*", F.lit(0).alias("newer"), F.lit(0).cast("long").alias("nth")))
        day = F.to_date("created_at")
        # the day belongs to the key, so a version that changes it stays apart
        merged = current_posts(versions.withColumn("day", day), order_cols=("newer", "nth"),
                               keys=(*KEYS, "day"), value_cols=list(VALUES))
        merged.select(*KEYS, *VALUES, "day").write.mode("overwrite").partitionBy("day").parquet(
            os.path.join(path, "state", f"batch={batch_id}"))
    finally:
        new.unpersist()
    state = _table(spark, path, "state", _STATE, "batch int, day date").where(F.col("batch") == batch_id)
    day_partials(state.drop("day")).write.mode("overwrite").parquet(
        os.path.join(path, "partials", f"batch={batch_id}"))
    if as_of is not None:
        report_now(spark, path, as_of, through=batch_id).write.mode("overwrite").parquet(
            os.path.join(path, "report", f"batch={batch_id}"))


def days_now(spark: SparkSession, path: str, through: int | None = None) -> DataFrame:
    """The day partials after the last batch (or ``through``): each day's newest rows."""
    partials = _table(spark, path, "partials", _PARTIALS, "batch int")
    if through is not None:
        partials = partials.where(F.col("batch") <= through)
    value = F.struct("mentions", "engagement", "sentiment_sum")
    return partials.groupBy("topic_id", "day").agg(F.max_by(value, "batch").alias("v")).select(
        "topic_id", "day", "v.*")


def report_now(spark: SparkSession, path: str, as_of: _dt.datetime, topics: DataFrame | None = None,
               through: int | None = None) -> DataFrame:
    """The gap-filled report with growth from the partials alone."""
    return report_from_days(days_now(spark, path, through), as_of, topics=topics)


def trends_stream(events: DataFrame, path: str, checkpoint: str, as_of: _dt.datetime | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Run ``apply_batch`` over a stream of post versions."""
    return (events.writeStream.foreachBatch(lambda b, n: apply_batch(b, n, path, as_of))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
