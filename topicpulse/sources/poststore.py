"""The stored post table: parquet by day, read by partition.

Posts are written under ``event_date=<day of created_at>``.  A look-back (48 h
re-send, 30 d backfill, report horizon) then lists only the days it needs: the
date filter prunes partitions before any file is opened, and the exact time is
checked on what is left.  A post without a time lies in the null partition and
is only in unbounded reads.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicpulse.functions.calendar import ts_lit
from topicpulse.session import PARQUET_OPTIONS

DATE_COL = "event_date"


def write_posts(posts: DataFrame, path: str, ts_col: str = "created_at", mode: str = "append",
                gather: bool = True) -> None:
    """Append (or overwrite) posts by day.

    ``rebalance`` gathers a day's rows into few files and splits a day that is
    too large for one task; AQE takes both sizes from the shuffled bytes.  Without
    ``gather`` each task writes a file a day of what it holds, and no text is shuffled:
    for posts that come in few large tasks.
    """
    dated = posts.withColumn(DATE_COL, F.to_date(ts_col))
    if gather:
        dated = dated.hint("rebalance", DATE_COL)
    dated.write.mode(mode).options(**PARQUET_OPTIONS).partitionBy(DATE_COL).parquet(path)


def read_posts(spark: SparkSession, path: str, since: _dt.datetime | None = None,
               until: _dt.datetime | None = None, ts_col: str = "created_at") -> DataFrame:
    """Posts with ``since <= created_at <= until``; other days are not listed."""
    posts = spark.read.parquet(path)
    if since is not None:
        posts = posts.where((F.col(DATE_COL) >= F.lit(since.date())) & (F.col(ts_col) >= ts_lit(since)))
    if until is not None:
        posts = posts.where((F.col(DATE_COL) <= F.lit(until.date())) & (F.col(ts_col) <= ts_lit(until)))
    return posts.drop(DATE_COL)


def read_windows(spark: SparkSession, path: str, windows: DataFrame,
                 ts_col: str = "created_at") -> DataFrame:
    """Posts inside any of the windows (since, until), which are only known at run time.

    The windows' days prune the store's partitions dynamically; each post comes
    once.  Overlapping windows are merged first (one row per window, few rows),
    so the exact check is an equi-join on the day and a range on at most the
    windows that touch that day.
    """
    by_start = Window.orderBy("since", "until").rowsBetween(Window.unboundedPreceding, -1)
    w = windows.where("since <= until").select("since", "until").distinct()
    w = w.withColumn("far", F.max("until").over(by_start))
    w = w.withColumn("block", F.sum(F.when(F.col("since") <= F.col("far"), 0).otherwise(1)).over(
        Window.orderBy("since", "until").rowsBetween(Window.unboundedPreceding, 0)))
    w = w.groupBy("block").agg(F.min("since").alias("_since"), F.max("until").alias("_until"))
    days = w.select("_since", "_until", F.explode(F.sequence(
        F.to_date("_since"), F.to_date("_until"))).alias(DATE_COL))
    # merged windows are disjoint, so a post meets one of them at most
    return (spark.read.parquet(path).join(days, DATE_COL)
            .where(F.col(ts_col).between(F.col("_since"), F.col("_until")))
            .drop(DATE_COL, "_since", "_until"))
