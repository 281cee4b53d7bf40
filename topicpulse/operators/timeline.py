"""Calendar-range timelines and summary cards over a report.

A timeline is the zero-filled bar series a chart shows for one window type
and one named range: bars start at the range start and step by 1 day,
7 days or 1 calendar month while they start before the range end.  Each bar
takes the report row whose ``start`` falls inside ``[bar, bar + step)``.

The range condition becomes an equality: for a metric start ``m`` its bar
is computed directly (day: ``trunc(m)``, week bars anchored on the range
start: ``start + floor(days(m - start) / 7) * 7``, month: ``trunc(m,
month)``), so bars and metrics meet on the key (topic_id, bar) instead of
in a nested-loop range join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicpulse.functions.calendar import range_bounds, resolve_range, ts_lit
from topicpulse.functions.scalars import sentiment_label
from topicpulse.operators.metrics import for_window

_STEP = {"1d": "INTERVAL 1 DAY", "1w": "INTERVAL 7 DAYS", "1m": "INTERVAL 1 MONTH"}


def _bar_of(start: Column, window_type: str, range_start: _dt.datetime) -> Column:
    if window_type == "1d":
        return F.date_trunc("day", start)
    if window_type == "1m":
        return F.date_trunc("month", start)
    rs = ts_lit(range_start)
    days = F.floor(F.datediff(start, rs) / F.lit(7)).cast("int") * F.lit(7)
    return rs + F.make_interval(days=days)


def timeline(report_df: DataFrame, window_type: str, range_name: str | None,
             as_of: _dt.datetime, clip_to_now: bool = False) -> DataFrame:
    """R1-R5 + J4: zero-filled chart points per topic.

    Columns: topic_id, end (bar start, epoch milliseconds — the chart's x
    value), mentions, engagement, sentiment, growth.  An empty bar has growth
    0 (not 1).  ``clip_to_now`` keeps bars starting at or before ``as_of``
    (the growth chart's domain).

    One pass over the report: every row of the window type emits its metric
    under its bar key, and the first row of each topic also emits the zero
    bars of the range; one aggregate per (topic_id, bar) keeps the metric
    whose start is latest (the reference takes the first match in report
    order, ``end`` descending).  The report leaves its rows hash-partitioned
    by topic_id, so neither the window nor the aggregate adds an exchange,
    and the report is computed once.
    """
    range_name = resolve_range(window_type, range_name)
    r_start, r_end = range_bounds(range_name, as_of)
    lo, hi = ts_lit(r_start), ts_lit(r_end)
    rows = for_window(report_df, window_type)
    first = F.row_number().over(Window.partitionBy("topic_id").orderBy("start")) == 1
    bar = _bar_of(F.col("start"), window_type, r_start)
    metric = F.struct(F.col("start").alias("start"), F.col("mentions").alias("mentions"),
                      F.col("engagement").alias("engagement"), F.col("sentiment").alias("sentiment"),
                      F.col("growth").alias("growth"))
    last = hi - F.expr("INTERVAL 1 MICROSECOND")
    bar_starts = F.sequence(lo, last, F.expr(_STEP[window_type]))
    empty = F.lit(None).cast(_METRIC_TYPE)
    entries = F.concat(
        F.when((bar >= lo) & (bar < hi),
               F.array(F.struct(bar.alias("bar"), metric.alias("m"))))
         .otherwise(F.array().cast(f"array<struct<bar:timestamp,m:{_METRIC_TYPE}>>")),
        F.when(F.col("_first"), F.transform(bar_starts, lambda b: F.struct(b.alias("bar"),
                                                                           empty.alias("m"))))
         .otherwise(F.array().cast(f"array<struct<bar:timestamp,m:{_METRIC_TYPE}>>")))
    e = (rows.withColumn("_first", first)
             .select("topic_id", F.inline(entries)))
    if clip_to_now:
        e = e.where(F.col("bar") <= ts_lit(as_of))
    j = (e.groupBy("topic_id", "bar")
          .agg(F.max_by(F.col("m"), F.col("m.start")).alias("m")))
    return j.select(
        "topic_id",
        F.unix_millis("bar").alias("end"),
        F.coalesce("m.mentions", F.lit(0)).cast("long").alias("mentions"),
        F.coalesce("m.engagement", F.lit(0)).cast("long").alias("engagement"),
        F.coalesce("m.sentiment", F.lit(0.0)).alias("sentiment"),
        F.coalesce("m.growth", F.lit(0.0)).alias("growth"))


_METRIC_TYPE = ("struct<start:timestamp,mentions:bigint,engagement:bigint,"
                "sentiment:double,growth:double>")


def summary(report_df: DataFrame, range_name: str, as_of: _dt.datetime) -> DataFrame:
    """Summary cards per topic over daily rows of the chosen range.

    Uses 1d rows only, whatever window is shown; takes every named range and
    raises on an unknown name; ``start`` after
    ``range_start - 1 s`` and before ``as_of``.  Sentiment is
    mention-weighted, 0 when there are no mentions.
    """
    r_start, _ = range_bounds(range_name, as_of)
    lo = r_start - _dt.timedelta(seconds=1)
    d = report_df.where((F.col("window_type") == "1d")
                        & (F.col("start") > ts_lit(lo)) & (F.col("start") < ts_lit(as_of)))
    agg = (d.groupBy("topic_id")
             .agg(F.sum("mentions").alias("mentions"),
                  F.sum("engagement").alias("engagement"),
                  F.sum(F.col("sentiment") * F.col("mentions")).alias("weighted")))
    sent = F.when(F.col("mentions") > 0, F.col("weighted") / F.col("mentions")).otherwise(F.lit(0.0))
    return agg.select("topic_id", F.col("mentions").cast("long").alias("mentions"),
                      F.col("engagement").cast("long").alias("engagement"),
                      sent.alias("sentiment"), sentiment_label(sent).alias("label"))
