"""Inputs derived from the driver tables with plain DataFrame expressions.

Every derivation is row-wise (or one equi-join), so it grows with the tables
and the same rows can be produced by SQL on the parquet files.

F1 ``posts``        — post feed with text (matching, sentiment, normalising)
F2 ``topic_posts``  — posts already assigned to a topic (reports, dashboards)
F3 ``post_log``     — many versions per key (upsert / latest state)
F4 ``topics``       — small inline catalogue covering every keyword shape
F4s ``topic_catalog`` — catalogue derived from ``events`` (one topic per event)
F6 ``raw_feed``     — raw feed records (``data`` struct) derived from events
F7 ``many_topics``  — one topic per document, with phrases and words of its text
F8 ``large_lexicon`` — the default lexicon and a sixteenth of the corpus's words
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.schemas import TOPIC_TABLE_SCHEMA
from topicpulse.session import scratch_dir
from topicpulse.sources.poststore import write_posts
from topicpulse.sources.tables import read_events, read_table

# Fixed clock of every derived query (never the wall clock).
AS_OF = _dt.datetime(2024, 1, 31, 12, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-01-31 12:00:00'"


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


# Tunables: posts of one task (AQE would size the tasks by the events alone, before
# their text is joined), and the least that is worth a task.
TASK_POSTS, MIN_TASK_POSTS = 1 << 14, 1 << 10
# Posts of one task that writes them: each of its files takes a day's share of them.
FILE_POSTS = 1 << 17
# Documents from which the join is a merge: AQE may else broadcast few events to the tasks
# that scan the documents, which are one where these are one file.
MERGE_DOCS = 1 << 12


def _with_doc_id(spark: SparkSession, sf_dir: str, task_posts: int = TASK_POSTS) -> tuple[DataFrame, DataFrame]:
    """(events dealt by the ``doc_id`` they are joined to, documents)."""
    ev = read_events(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents")
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    if docs.count() >= MERGE_DOCS:
        docs = docs.hint("merge")
    n = ev.count()
    tasks = max(n // task_posts, min(spark.sparkContext.defaultParallelism, n // MIN_TASK_POSTS)) + 1
    return ev.withColumn("doc_id", F.col("event_id") % n_docs).repartition(tasks, "doc_id"), docs


def posts(spark: SparkSession, sf_dir: str, task_posts: int = TASK_POSTS) -> DataFrame:
    """events joined to a document by ``doc_id = event_id % n_docs``."""
    # The text is the bulk of a post, so it is never shuffled here: the narrow
    # events are dealt by their document, and what follows runs in the tasks of
    # the join.
    ev, docs = _with_doc_id(spark, sf_dir, task_posts)
    ev = ev.select(
        F.concat(F.lit("t3_"), F.col("event_id").cast("string")).alias("event_id"),
        "doc_id",
        F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("author"),
        F.col("ts").alias("created_at"),
        F.floor("value").cast("int").alias("score"),
        _k(F.col("props")).alias("num_comments"),
    )
    d = docs.select("doc_id", "text", "lang", F.col("source").alias("subreddit"))
    return (ev.join(d, "doc_id", "inner")
              .withColumn("engagement",
                          F.col("score") + F.col("num_comments") + F.lit(1))
              .select("event_id", "subreddit", "author", "created_at", "text",
                      "lang", "score", "num_comments", "engagement"))


_STORES: dict[tuple, str] = {}


def _store(spark: SparkSession, name: str, sf_dir: str, write) -> str:
    """A table written once per application under the scratch folder; its path."""
    at = (spark.sparkContext.applicationId, name, sf_dir)
    if at not in _STORES:
        path = scratch_dir(spark, name)
        write(path)
        _STORES[at] = path
    return _STORES[at]


def post_store(spark: SparkSession, sf_dir: str) -> str:
    """F1 as a deployment keeps it: parquet by day, written by the tasks that join the texts."""
    return _store(spark, "posts", sf_dir,
                  lambda path: write_posts(posts(spark, sf_dir, FILE_POSTS), path, gather=False))


def stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 from its store, with the day column that cutoffs prune by."""
    return spark.read.parquet(post_store(spark, sf_dir))


def topic_store(spark: SparkSession, sf_dir: str) -> str:
    """F4s with its final ids as a stored catalogue, sorted by id."""
    from topicpulse.operators.topics import with_topic_ids, write_topics

    return _store(spark, "topics", sf_dir,
                  lambda path: write_topics(with_topic_ids(topic_catalog(spark, sf_dir)), path))


def topic_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: topic_id = event_type; sentiment 0.5 when value >= 50 else -0.25."""
    ev = read_events(spark, sf_dir)
    return ev.select(
        F.col("event_type").alias("topic_id"),
        F.concat(F.lit("t3_"), F.col("event_id").cast("string")).alias("event_id"),
        F.col("ts").alias("created_at"),
        (F.floor("value").cast("int") + _k(F.col("props")) + F.lit(1)).alias("engagement"),
        F.when(F.col("value") >= 50, F.lit(0.5)).otherwise(F.lit(-0.25))
         .alias("sentiment_score"),
    )


def post_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """versions keyed (topic_id, event_id=user_id); arrival = (ts, seq).

    Nulls appear the way a partial document update leaves them out:
    num_comments is missing when k % 10 = 0, sentiment when value < 20.
    """
    ev = read_events(spark, sf_dir)
    k = _k(F.col("props"))
    return ev.select(
        F.col("event_type").alias("topic_id"),
        F.col("user_id").cast("string").alias("event_id"),
        F.col("ts").alias("arrival_ts"),
        F.col("event_id").alias("seq"),
        F.floor("value").cast("int").alias("score"),
        F.when(k % 10 == 0, F.lit(None).cast("int")).otherwise(k).alias("num_comments"),
        F.when(F.col("value") < 20, F.lit(None).cast("double"))
         .otherwise(F.col("value") / 100.0).alias("sentiment_score"),
    )


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw feed records shaped like the remote API's ``data`` objects.

    Gaps are injected by rule so the normaliser meets every case:
    event_id % 7 = 0 → no id, % 5 = 0 → no name, % 3 = 0 → no title,
    % 4 = 0 → no author, % 11 = 0 → score is fractional text,
    % 13 = 0 → score is not a number, % 17 = 0 → no created_utc.
    """
    ev, docs = _with_doc_id(spark, sf_dir)
    i = F.col("event_id")
    e = ev.select("event_id", "user_id", "ts", "value", "props", "doc_id")
    j = e.join(docs.select("doc_id", "text", "source"), "doc_id", "inner")
    null_s = F.lit(None).cast("string")
    score_txt = (F.when(i % 13 == 0, F.lit("n/a"))
                  .when(i % 11 == 0, F.concat(F.floor("value").cast("string"), F.lit(".7")))
                  .otherwise(F.floor("value").cast("string")))
    data = F.struct(
        F.when(i % 7 == 0, null_s).otherwise(F.lower(F.hex(i))).alias("id"),
        F.when((i % 5 == 0) | (i % 7 == 0), null_s)
         .otherwise(F.concat(F.lit("t3_"), F.lower(F.hex(i)))).alias("name"),
        F.col("source").alias("subreddit"),
        F.when(i % 4 == 0, null_s)
         .otherwise(F.concat(F.lit("u_"), F.col("user_id").cast("string"))).alias("author"),
        F.when(i % 17 == 0, F.lit(None).cast("double"))
         .otherwise(F.unix_micros("ts").cast("double") / 1e6).alias("created_utc"),
        score_txt.alias("score"),
        F.when(i % 3 == 0, null_s)
         .otherwise(F.concat(F.lit("post "), i.cast("string"))).alias("title"),
        F.col("text").alias("selftext"),
        _k(F.col("props")).cast("string").alias("num_comments"),
    )
    return j.select(data.alias("data"))


# The inline topic catalogue (F4) — one topic per keyword shape.
F4_TOPICS = [
    ("cnf-two", '[["thble","thing"],["attion","erble"]]'),
    ("phrase", '[["of the"],["best","ering"]]'),
    ("flat", '["best","thanedble"]'),
    ("no-rules", "[]"),
    ("empty-group", '[["thing"],[]]'),
    ("raw-text", "thing"),
]


def topics(spark: SparkSession, subreddits: str = "") -> DataFrame:
    """the six reference-shaped topics; ``subreddits`` CSV for all."""
    created = _dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(tid, f"topic {tid}", kw, subreddits, "{}", 60, created, "IDLE", 0.0)
            for tid, kw in F4_TOPICS]
    return spark.createDataFrame(rows, TOPIC_TABLE_SCHEMA)


def topic_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4s: one stored topic row per event, covering every catalogue quirk.

    id:        %4 = 0 clean slug, 1 has upper case and spaces, 2 missing,
               3 contains 'topic-id'
    keywords:  %6 = 0 nested with a phrase, 1 flat with blank and duplicate,
               2 nested with padded duplicate and an empty group, 3 raw text,
               4 empty list, 5 missing
    subreddits: CSV with padding and a blank entry; missing when %9 = 0
    """
    ev = read_events(spark, sf_dir)
    i = F.col("event_id")
    et = F.col("event_type")
    k = _k(F.col("props"))
    uid = F.col("user_id").cast("string")
    null_s = F.lit(None).cast("string")
    tid = (F.when(i % 4 == 0, F.concat(F.lit("topic-"), i.cast("string")))
            .when(i % 4 == 1, F.concat(F.lit("Topic "), F.upper(et), F.lit(" "), i.cast("string")))
            .when(i % 4 == 2, null_s)
            .otherwise(F.concat(F.lit("my-topic-id-"), i.cast("string"))))
    kw = (F.when(i % 6 == 0, F.concat(F.lit('[["'), et, F.lit('","u'), uid,
                                      F.lit('"],["k'), k.cast("string"), F.lit(" "), et, F.lit('"]]')))
           .when(i % 6 == 1, F.concat(F.lit('["'), et, F.lit('","  ","'), et, F.lit('"]')))
           .when(i % 6 == 2, F.concat(F.lit('[["'), et, F.lit('"," '), et, F.lit(' "],[]]')))
           .when(i % 6 == 3, et)
           .when(i % 6 == 4, F.lit("[]"))
           .otherwise(null_s))
    subs = (F.when(i % 9 == 0, null_s)
             .otherwise(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"),
                                 F.lit(", src"), (k % 20).cast("string"), F.lit(", ,SRC"),
                                 (i % 20).cast("string"))))
    return ev.select(
        tid.alias("id"),
        F.concat(F.lit("Posts about "), et, F.lit(" from user "), uid).alias("description"),
        kw.alias("keywords"),
        subs.alias("subreddits"),
        F.when(i % 5 == 0, null_s)
         .otherwise(F.concat(F.lit('{"lang":"'), F.when(k % 2 == 0, F.lit("en")).otherwise(F.lit("fr")),
                             F.lit('"}'))).alias("filters_json"),
        F.lit(60).alias("update_frequency_seconds"),
        F.col("ts").alias("created_at"),
        F.lit("IDLE").alias("backfill_status"),
        F.lit(0.0).cast("float").alias("backfill_percentage"),
        i.alias("seq"),
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"),
                    lambda x: x != F.lit(""))


def many_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic ``doc-<id>``, parsed: (words 2-4 or 12-14 as phrases) AND (word 8, 20 or 30).

    A group without any of its terms stays empty, so such a topic never matches.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", _words(F.col("text")).alias("w"))
    w = F.col("w")

    def phrase(i: int) -> Column:
        return F.when(F.size(w) >= i + 2, F.array_join(F.slice(w, i, 3), " "))

    def given(*terms: Column) -> Column:
        return F.array_distinct(F.filter(F.array(*terms), lambda x: x.isNotNull()))

    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("topic_id"),
        F.array(given(phrase(2), phrase(12)),
                given(*[F.try_element_at(w, F.lit(i)) for i in (8, 20, 30)])).alias("cnf"),
        F.array().cast("array<string>").alias("subs"))


def large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: words whose md5 begins with 0, polarity -1 to 1 by further digits of it."""
    from topicpulse.functions.sentiment import default_lexicon

    base = default_lexicon(spark)
    docs = read_table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).distinct()
    number = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 2, 4), 16, 10).cast("int")
    more = words.where(F.md5(F.col("word").cast("binary")).startswith("0")).join(
        base, "word", "left_anti").select(
        "word", ((number % 201 - 100) / F.lit(100.0)).alias("polarity"), F.lit(1.0).alias("intensity"),
        F.lit(False).alias("negation"))
    return base.unionByName(more)


# Latin letters of the posts and what stands for them in the Cyrillic feed.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувъжыз"


def cyrillic_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with its letters a to z written in Cyrillic."""
    return posts(spark, sf_dir).withColumn("text", F.translate(F.lower("text"), LATIN, CYRILLIC))


def cyrillic_topics(spark: SparkSession) -> DataFrame:
    """F4 with Cyrillic keywords."""
    return topics(spark, "").withColumn("keywords", F.translate("keywords", LATIN, CYRILLIC))
