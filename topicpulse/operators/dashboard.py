"""Dashboard panels: KPI tiles and daily histograms over matched posts.

The dashboard filters rows with engagement AND sentiment present, a
relative range ``[as_of - 1 month, as_of]`` and an optional exact topic
picker; its metrics differ from the report on purpose (true ``avg`` over
non-null values, null instead of 0 for empty tiles / days).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicpulse.functions.calendar import _add_months, ts_lit


def dashboard_range(as_of: _dt.datetime) -> tuple[_dt.datetime, _dt.datetime]:
    """Now-1M … now."""
    return _add_months(as_of, -1), as_of


def dashboard_base(df: DataFrame, as_of: _dt.datetime, topics: list[str] | None = None,
                   ts_col: str = "created_at") -> DataFrame:
    """P12 + P13 + P14 (all pushed down to the scan when they can be)."""
    lo, hi = dashboard_range(as_of)
    out = df.where(F.col("engagement").isNotNull() & F.col("sentiment_score").isNotNull()
                   & F.col(ts_col).between(ts_lit(lo), ts_lit(hi)))
    if topics is not None:
        out = out.where(F.col("topic_id").isin(list(topics)))
    return out


def kpis(df: DataFrame, as_of: _dt.datetime, topics: list[str] | None = None,
         ts_col: str = "created_at") -> DataFrame:
    """One row — matched posts (null when 0), avg sentiment, sum engagement."""
    b = dashboard_base(df, as_of, topics, ts_col)
    return b.agg(
        F.nullif(F.count(F.lit(1)), F.lit(0)).alias("matched_posts"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.sum("engagement").cast("long").alias("engagement"))


def daily_panel(df: DataFrame, as_of: _dt.datetime, metric: str,
                topics: list[str] | None = None, ts_col: str = "created_at") -> DataFrame:
    """Per-day series over the dashboard range, empty days kept.

    metric 'count' → 0 on empty days; 'engagement' (sum) and 'sentiment'
    (avg) → null on empty days.
    """
    lo, hi = dashboard_range(as_of)
    b = dashboard_base(df, as_of, topics, ts_col)
    day = F.date_trunc("day", F.col(ts_col)).alias("day")
    if metric == "count":
        agg = F.count(F.lit(1)).alias("value")
    elif metric == "engagement":
        agg = F.sum("engagement").cast("long").alias("value")
    elif metric == "sentiment":
        agg = F.avg("sentiment_score").alias("value")
    else:
        raise ValueError(f"unknown panel metric {metric!r}")
    per_day = b.groupBy(day).agg(agg)
    spark = df.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(
        F.date_trunc("day", ts_lit(lo)), F.date_trunc("day", ts_lit(hi)),
        F.expr("INTERVAL 1 DAY"))).alias("day"))
    # Both sides hold at most one row per calendar day of the range.
    out = days.join(per_day, "day", "left")
    value = F.coalesce("value", F.lit(0)).cast("long") if metric == "count" else F.col("value")
    return out.select("day", value.alias("value"))


def topic_options(df: DataFrame, as_of: _dt.datetime, ts_col: str = "created_at") -> DataFrame:
    """Topics offered by the picker, with their document counts under the
    dashboard's own filters and time range."""
    return dashboard_base(df, as_of, ts_col=ts_col).groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("doc_count"))
