"""Declared schemas of the event records and the topic catalogue."""

from pyspark.sql import types as T

# Matched-post event as it travels between stages (JSON on the wire).
# ``ingested_at`` is deliberately absent: the enrichment stage drops it.
POST_SCHEMA = T.StructType([
    T.StructField("topic_id", T.StringType(), True),
    T.StructField("event_id", T.StringType(), True),
    T.StructField("created_utc", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
    T.StructField("score", T.IntegerType(), True),
    T.StructField("num_comments", T.IntegerType(), True),
    T.StructField("subreddit", T.StringType(), True),
    T.StructField("author", T.StringType(), True),
    T.StructField("engagement", T.IntegerType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
])

ENRICHED_SCHEMA = T.StructType(
    POST_SCHEMA.fields + [T.StructField("sentiment_score", T.FloatType(), True)])

# Raw feed record: every field optional, numbers may arrive as text.
RAW_POST_SCHEMA = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("id", T.StringType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("subreddit", T.StringType(), True),
        T.StructField("author", T.StringType(), True),
        T.StructField("created_utc", T.StringType(), True),
        T.StructField("score", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("selftext", T.StringType(), True),
        T.StructField("num_comments", T.StringType(), True),
    ]), True),
])

# Topic catalogue in its stored (relational) form.
TOPIC_TABLE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("keywords", T.StringType(), True),
    T.StructField("subreddits", T.StringType(), True),
    T.StructField("filters_json", T.StringType(), True),
    T.StructField("update_frequency_seconds", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("backfill_status", T.StringType(), True),
    T.StructField("backfill_percentage", T.FloatType(), True),
])

FILTERS_DDL = "text string, lang string, author string"

# Backfill task message.
TASK_SCHEMA = T.StructType([
    T.StructField("topic_id", T.StringType(), True),
    T.StructField("subreddits", T.ArrayType(T.StringType()), True),
])

# Backfill status states.
STATUS_IDLE = "IDLE"
STATUS_PENDING = "PENDING"
STATUS_COMPLETED = "COMPLETED"
