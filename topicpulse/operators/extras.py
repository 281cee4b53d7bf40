"""Fields the reference declares for its metric rows but never computes.

X1 sentiment split counts per bucket, X2 top keywords per bucket, X3 the
stored topic filters (text / lang / author) applied to matched posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicpulse.functions.rules import parse_filters
from topicpulse.functions.scalars import NEGATIVE_AT, POSITIVE_AT
from topicpulse.functions.sentiment import tokens
from topicpulse.operators.metrics import _grain_array


def sentiment_split(posts: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """Positive / negative / neutral post counts per bucket (C11 thresholds).

    Day partials first (one shuffle, map-side combined), then the grain
    explode on the partials.
    """
    s = F.col("sentiment_score")
    days = (posts.groupBy("topic_id", F.date_trunc("day", F.col(ts_col)).alias("day"))
                 .agg(F.count_if(s >= F.lit(POSITIVE_AT)).alias("positive"),
                      F.count_if(s <= F.lit(NEGATIVE_AT)).alias("negative"),
                      F.count(F.lit(1)).alias("n")))
    g = days.select("topic_id", F.inline(_grain_array(F.col("day"))), "positive", "negative", "n")
    return (g.groupBy("topic_id", "window_type", "start")
             .agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"),
                  F.sum("n").alias("n"))
             .select("topic_id", "window_type", "start", "positive", "negative",
                     (F.col("n") - F.col("positive") - F.col("negative")).alias("neutral")))


def top_keywords(posts: DataFrame, k: int = 5, ts_col: str = "created_at",
                 tokens_col: str | None = None) -> DataFrame:
    """The ``k`` tokens found in most posts of each bucket.

    Rows: topic_id, window_type, start, rank, key, doc_count.  Tokens are
    counted once per post; ties go to the smaller key.  ``tokens_col`` names
    a token array that the matcher already made.  Plan: explode the
    distinct tokens of each post → count per (topic, day, token), combined
    map-side → grain explode of those day counts → sum per bucket →
    ``row_number() <= k`` (a WindowGroupLimit keeps only k rows per bucket
    and map task).  Counting per day first is measurably cheaper than
    exploding the three buckets on every (post, token) row: the second
    aggregate sees already-reduced rows.
    """
    words = F.array_remove(tokens_col, "") if tokens_col else tokens(F.col("text"))
    # the day is a column of the post, else it is made again for every token
    dated = posts.withColumn("day", F.date_trunc("day", F.col(ts_col)))
    toks = dated.select("topic_id", "day", F.explode(F.array_distinct(words)).alias("key"))
    days = toks.groupBy("topic_id", "day", "key").agg(F.count(F.lit(1)).alias("doc_count"))
    g = days.select("topic_id", F.inline(_grain_array(F.col("day"))), "key", "doc_count")
    b = g.groupBy("topic_id", "window_type", "start", "key").agg(
        F.sum("doc_count").alias("doc_count"))
    w = Window.partitionBy("topic_id", "window_type", "start").orderBy(
        F.col("doc_count").desc(), F.col("key"))
    return b.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_keywords_arrays(top: DataFrame) -> DataFrame:
    """X2 in the declared shape: ``top_keywords`` array<struct<key, doc_count>>."""
    agg = top.groupBy("topic_id", "window_type", "start").agg(
        F.array_sort(F.collect_list(F.struct("rank", "key", "doc_count"))).alias("_t"))
    return agg.select("topic_id", "window_type", "start",
                      F.transform("_t", lambda x: F.struct(x["key"].alias("key"),
                                                           x["doc_count"].alias("doc_count")))
                       .alias("top_keywords"))


def apply_topic_filters(matched: DataFrame, topics: DataFrame) -> DataFrame:
    """Keep matched posts that satisfy their topic's stored filters.

    text: case-insensitive substring of the post text; lang: equal,
    case-insensitive; author: equal.  A missing or empty filter does not
    restrict.  Spark broadcasts the catalogue side when its size in bytes
    allows; else AQE splits a hot topic's partition.
    """
    tid = F.col("topic_id") if "topic_id" in topics.columns else F.col("id")
    f = topics.select(tid.alias("topic_id"), parse_filters(F.col("filters_json")).alias("_f"))
    j = matched.join(f, "topic_id", "left")
    ft, fl, fa = F.col("_f.text"), F.col("_f.lang"), F.col("_f.author")
    ok_text = ft.isNull() | (ft == "") | (F.instr(F.lower(F.col("text")), F.lower(ft)) > 0)
    ok_lang = fl.isNull() | (fl == "") | (F.lower(F.col("lang")) == F.lower(fl))
    ok_auth = fa.isNull() | (fa == "") | (F.col("author") == fa)
    return j.where(F.coalesce(ok_text & ok_lang & ok_auth, F.lit(False))).drop("_f")
