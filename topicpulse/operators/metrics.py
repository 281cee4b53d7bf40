"""Trend report: three-grain gap-filled histograms, growth and trend score.

Plan shape (one scan of the posts, one real shuffle of raw rows):

  posts ─partial agg─▶ Exchange(topic_id, day) ─▶ day partials      (A2-A4)
  day partials ─Exchange(topic_id)─▶ per-topic min/max window ─▶
      explode: 3 grain entries per day + the spine once per topic   (A1, A5, D5)
  ─▶ agg(topic_id, window_type, start) ─▶ lag window                (W1-W3)

Everything after the day partials is at most one row per topic and bucket,
so a hot topic (a third of all posts) only costs one partial row per map task
and day; there is no per-post state after the first aggregation.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicpulse.functions.calendar import BUCKET_DAYS, ts_lit

# Report horizon (now-2y/d … now+1d/d) and grain order.
HORIZON_BACK_YEARS = 2
HORIZON_AHEAD_DAYS = 1
GRAIN_RANK = {"1d": 0, "1w": 1, "1m": 2}
_TRUNC = {"1d": "day", "1w": "week", "1m": "month"}
_STEP = {"1d": "INTERVAL 1 DAY", "1w": "INTERVAL 7 DAYS", "1m": "INTERVAL 1 MONTH"}


def horizon(as_of: _dt.datetime) -> tuple[_dt.datetime, _dt.datetime]:
    """Extended bounds ``now-2y/d`` and ``now+1d/d``."""
    try:
        lo = as_of.replace(year=as_of.year - HORIZON_BACK_YEARS)
    except ValueError:  # 29 February
        lo = as_of.replace(year=as_of.year - HORIZON_BACK_YEARS, day=28)
    lo = lo.replace(hour=0, minute=0, second=0, microsecond=0)
    hi = (as_of + _dt.timedelta(days=HORIZON_AHEAD_DAYS)).replace(
        hour=0, minute=0, second=0, microsecond=0)
    return lo, hi


def day_partials(posts: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """(topic_id, day) → n, engagement sum, sentiment sum.

    The only aggregation over raw posts; Spark runs it map-side first
    (partial_count / partial_sum) so the shuffle carries one row per
    (map task, topic, day).
    """
    return (posts
            .groupBy("topic_id", F.date_trunc("day", F.col(ts_col)).alias("day"))
            .agg(F.count(F.lit(1)).alias("mentions"),
                 F.sum("engagement").alias("engagement"),
                 F.sum("sentiment_score").alias("sentiment_sum")))


def _grain_array(day: Column) -> Column:
    return F.array(*[
        F.struct(F.lit(wt).alias("window_type"),
                 (day if wt == "1d" else F.date_trunc(_TRUNC[wt], day)).alias("start"))
        for wt in GRAIN_RANK])


def bucket_metrics(posts: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """A1-A4 without gap filling: non-empty buckets of all three grains."""
    return buckets_from_days(day_partials(posts, ts_col))


def buckets_from_days(days: DataFrame) -> DataFrame:
    g = days.select("topic_id", F.inline(_grain_array(F.col("day"))),
                    "mentions", "engagement", "sentiment_sum")
    return (g.groupBy("topic_id", "window_type", "start")
             .agg(F.sum("mentions").alias("mentions"),
                  F.sum("engagement").alias("engagement"),
                  F.sum("sentiment_sum").alias("sentiment_sum")))


def _end(start: Column, wt: Column) -> Column:
    days = (F.when(wt == "1d", F.lit(BUCKET_DAYS["1d"]))
             .when(wt == "1w", F.lit(BUCKET_DAYS["1w"]))
             .otherwise(F.lit(BUCKET_DAYS["1m"])))
    return start + F.make_interval(days=days)


def report(posts: DataFrame, as_of: _dt.datetime, topic_id: str | None = None,
           topics: DataFrame | None = None, ts_col: str = "created_at") -> DataFrame:
    """Gap-filled three-grain metrics with growth and trend score.

    posts:   topic_id, <ts_col>, engagement, sentiment_score
    topic_id: restrict to one topic (filter pushed to the scan); a topic
             without posts still gets an all-zero series.
    topics:  optional DataFrame with ``topic_id`` — catalogue topics without
             posts get all-zero series as well.
    Columns: topic_id, start, end, mentions, engagement, sentiment, growth,
             trend_score, window_type (timestamps typed, UTC).
    """
    if topic_id is not None:
        posts = posts.where(F.col("topic_id") == F.lit(topic_id))
    return report_from_days(day_partials(posts, ts_col), as_of, topic_id, topics)


def report_from_days(days: DataFrame, as_of: _dt.datetime, topic_id: str | None = None,
                     topics: DataFrame | None = None) -> DataFrame:
    """``report`` from day partials (topic_id, day, mentions, engagement, sentiment_sum)."""
    spark = days.sparkSession
    if topic_id is not None:
        days = days.where(F.col("topic_id") == F.lit(topic_id))
    extra_ids = None
    if topic_id is not None:
        extra_ids = spark.range(1).select(F.lit(topic_id).alias("topic_id"))
    elif topics is not None:
        extra_ids = topics.select("topic_id").distinct()
    if extra_ids is not None:
        days = days.unionByName(extra_ids.select(
            "topic_id", F.lit(None).cast("timestamp").alias("day"),
            F.lit(0).cast("long").alias("mentions"),
            F.lit(None).cast("long").alias("engagement"),
            F.lit(None).cast("double").alias("sentiment_sum")))

    # One exchange of the day partials by topic_id.  Every later step (bounds,
    # spine, bucket sums, lag) is keyed by a superset of topic_id, so Spark
    # adds no further shuffle and the posts are scanned once.
    wt = (Window.partitionBy("topic_id").orderBy(F.col("day").asc_nulls_last())
                .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wr = Window.partitionBy("topic_id").orderBy(F.col("day").asc_nulls_last())
    lo_ext, hi_ext = horizon(as_of)
    lo = F.least(F.min("day").over(wt), ts_lit(lo_ext))
    hi = F.greatest(F.max("day").over(wt), ts_lit(hi_ext))

    def entry(wtype, start, m, e, s):
        return F.struct(F.lit(wtype).alias("window_type"), start.alias("start"),
                        m.alias("mentions"), e.alias("engagement"), s.alias("sentiment_sum"))

    data_entries = F.when(F.col("day").isNotNull(), F.array(*[
        entry(w, F.col("day") if w == "1d" else F.date_trunc(_TRUNC[w], F.col("day")),
              F.col("mentions"), F.col("engagement"), F.col("sentiment_sum"))
        for w in GRAIN_RANK]))
    zero_m, null_e, null_s = (F.lit(0).cast("long"), F.lit(None).cast("long"),
                              F.lit(None).cast("double"))
    def zero_entry(wtype):
        return lambda st: entry(wtype, st, zero_m, null_e, null_s)

    spine_entries = F.when(F.col("first"), F.concat(*[
        F.transform(F.sequence(F.date_trunc(_TRUNC[w], F.col("lo")),
                               F.date_trunc(_TRUNC[w], F.col("hi")), F.expr(_STEP[w])),
                    zero_entry(w))
        for w in GRAIN_RANK]))
    entries = F.concat(F.coalesce(data_entries, F.array().cast(_ENTRY_TYPE)),
                       F.coalesce(spine_entries, F.array().cast(_ENTRY_TYPE)))

    filled = (days.repartition("topic_id")
                  .select("*", lo.alias("lo"), hi.alias("hi"),
                          (F.row_number().over(wr) == 1).alias("first"))
                  .select("topic_id", F.inline(entries))
                  .groupBy("topic_id", "window_type", "start")
                  .agg(F.sum("mentions").alias("mentions"),
                       F.coalesce(F.sum("engagement"), F.lit(0)).cast("long").alias("engagement"),
                       F.sum("sentiment_sum").alias("sentiment_sum")))

    w = Window.partitionBy("topic_id", "window_type").orderBy("start")
    prev = F.lag("mentions", 1, 0).over(w)
    growth = F.when(prev == 0, F.lit(1.0)).otherwise(F.col("mentions") / prev)
    sentiment = F.when(F.col("mentions") > 0,
                       F.coalesce(F.col("sentiment_sum"), F.lit(0.0)) / F.col("mentions")
                       ).otherwise(F.lit(0.0))
    return (filled
            .withColumn("growth", growth.cast("double"))
            .select("topic_id", "start",
                    _end(F.col("start"), F.col("window_type")).alias("end"),
                    "mentions", "engagement",
                    sentiment.cast("double").alias("sentiment"),
                    "growth",
                    (F.col("engagement") * F.col("growth")).alias("trend_score"),
                    "window_type"))


_ENTRY_TYPE = ("array<struct<window_type:string,start:timestamp,mentions:bigint,"
               "engagement:bigint,sentiment_sum:double>>")


def order_report(report_df: DataFrame) -> DataFrame:
    """O1: ``end`` descending; ties keep day, week, month order."""
    rank = (F.when(F.col("window_type") == "1d", F.lit(0))
             .when(F.col("window_type") == "1w", F.lit(1)).otherwise(F.lit(2)))
    return report_df.orderBy(F.col("end").desc(), rank, F.col("topic_id"), F.col("start"))


def available_windows(report_df: DataFrame) -> DataFrame:
    """D3: distinct window types present in a report."""
    return report_df.select("window_type").distinct()


def for_window(report_df: DataFrame, window_type: str) -> DataFrame:
    """Rows of one window type."""
    return report_df.where(F.col("window_type") == F.lit(window_type))
