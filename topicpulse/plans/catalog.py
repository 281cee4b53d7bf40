"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator group.

Each query derives its input from the driver tables (see
``topicpulse.sources.fixtures``) and runs over whole tables.  The matching
DuckDB SQL lives in ``topicpulse.plans.oracle`` under the same name.
"""

from __future__ import annotations

import datetime as dt
import os as _os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.functions import rules as RU
from topicpulse.functions import sentiment as SE
from topicpulse.functions.calendar import cutoff as _cutoff
from topicpulse.operators import dashboard as D
from topicpulse.operators import extras as EX
from topicpulse.operators import matching as MT
from topicpulse.operators import metrics as M
from topicpulse.operators import normalize as NO
from topicpulse.operators import state as ST
from topicpulse.operators import timeline as TL
from topicpulse.operators import topics as TO
from topicpulse.plans.output import present
from topicpulse.schemas import POST_SCHEMA
from topicpulse.session import SPLIT_OPTIONS, TEXT_OPTIONS, scratch_dir
from topicpulse.sources import fixtures as fx
from topicpulse.sources import poststore as PS
from topicpulse.sources.posts import read_raw_posts
from topicpulse.streaming import backfill as BF
from topicpulse.streaming import enrich as EN
from topicpulse.streaming import sync as SY
from topicpulse.streaming import trends as TR
from topicpulse.streaming import upsert as UP

AS_OF = fx.AS_OF
REPORT_TOPIC = "click"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    """Add a query to the registry; calls run with the session zone at UTC."""
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


# ---------------------------------------------------------------- phase 1
@register("report_topic")
def report_topic(spark, sf_dir):
    r = M.report(fx.topic_posts(spark, sf_dir), AS_OF, topic_id=REPORT_TOPIC)
    return present(M.order_report(r))


@register("report_all_topics")
def report_all_topics(spark, sf_dir):
    return present(M.report(fx.topic_posts(spark, sf_dir), AS_OF))


@register("bucket_metrics")
def bucket_metrics(spark, sf_dir):
    return present(M.bucket_metrics(fx.topic_posts(spark, sf_dir)))


# ---------------------------------------------------------------- phase 2
def _report_all(spark, sf_dir):
    return M.report(fx.topic_posts(spark, sf_dir), AS_OF)


@register("timeline_1d_this_week")
def timeline_1d_this_week(spark, sf_dir):
    return present(TL.timeline(_report_all(spark, sf_dir), "1d", "this_week", AS_OF))


@register("timeline_1w_3m")
def timeline_1w_3m(spark, sf_dir):
    return present(TL.timeline(_report_all(spark, sf_dir), "1w", "3m", AS_OF))


@register("timeline_1m_12m")
def timeline_1m_12m(spark, sf_dir):
    return present(TL.timeline(_report_all(spark, sf_dir), "1m", "12m", AS_OF))


@register("growth_clipped")
def growth_clipped(spark, sf_dir):
    t = TL.timeline(_report_all(spark, sf_dir), "1d", "this_month", AS_OF, clip_to_now=True)
    return present(t.select("topic_id", "end", "growth"))


@register("summary_this_month")
def summary_this_month(spark, sf_dir):
    return present(TL.summary(_report_all(spark, sf_dir), "this_month", AS_OF))


@register("available_windows")
def available_windows(spark, sf_dir):
    return M.available_windows(_report_all(spark, sf_dir))


# ---------------------------------------------------------------- phase 5
@register("kpis")
def kpis(spark, sf_dir):
    return present(D.kpis(fx.topic_posts(spark, sf_dir), AS_OF))


@register("daily_matched")
def daily_matched(spark, sf_dir):
    return present(D.daily_panel(fx.topic_posts(spark, sf_dir), AS_OF, "count"))


@register("daily_engagement")
def daily_engagement(spark, sf_dir):
    return present(D.daily_panel(fx.topic_posts(spark, sf_dir), AS_OF, "engagement"))


@register("daily_sentiment")
def daily_sentiment(spark, sf_dir):
    return present(D.daily_panel(fx.topic_posts(spark, sf_dir), AS_OF, "sentiment"))


@register("topic_options")
def topic_options(spark, sf_dir):
    return D.topic_options(fx.topic_posts(spark, sf_dir), AS_OF)


def _posts_with_gaps(spark, sf_dir):
    """F2 with missing engagement and sentiment, and a third of it 40 days older."""
    n = F.expr("CAST(substring(event_id, 4) AS BIGINT)")
    tp = fx.topic_posts(spark, sf_dir)
    return tp.withColumns({
        "created_at": F.expr("created_at") - F.when(n % 3 == 0, F.expr("INTERVAL 40 DAY"))
        .otherwise(F.expr("INTERVAL 0 DAY")),
        "engagement": F.when(n % 7 != 0, F.col("engagement")),
        "sentiment_score": F.when(n % 11 != 0, F.col("sentiment_score"))})


@register("topic_options_gaps")
def topic_options_gaps(spark, sf_dir):
    return D.topic_options(_posts_with_gaps(spark, sf_dir), AS_OF)


@register("kpis_gaps")
def kpis_gaps(spark, sf_dir):
    return present(D.kpis(_posts_with_gaps(spark, sf_dir), AS_OF))


@register("kpis_month_end")
def kpis_month_end(spark, sf_dir):
    """KPIs on 31 March, over posts moved 60 days on."""
    moved = fx.topic_posts(spark, sf_dir).withColumn(
        "created_at", F.col("created_at") + F.expr("INTERVAL 60 DAY"))
    return present(D.kpis(moved, dt.datetime(2024, 3, 31, 12)))


# ---------------------------------------------------------------- phase 3


SRC_0_9 = ",".join(f"src{i}" for i in range(10))
FETCH_CAP = 150


def _match_out(m):
    return present(m.select("topic_id", "event_id", "subreddit", "created_at", "engagement"))


@register("match_cnf_narrow")
def match_cnf_narrow(spark, sf_dir):
    return _match_out(MT.match_posts(fx.posts(spark, sf_dir), fx.topics(spark, SRC_0_9),
                                     strategy="narrow"))


@register("match_cnf_inverted")
def match_cnf_inverted(spark, sf_dir):
    return _match_out(MT.match_posts(fx.posts(spark, sf_dir), fx.topics(spark, ""),
                                     strategy="inverted"))


@register("match_many_terms")
def match_many_terms(spark, sf_dir):
    """A catalogue beyond the narrow plan's bounds: one topic per document, five terms
    each, keyed by their rarest runs."""
    posts, topics = fx.posts(spark, sf_dir), fx.many_topics(spark, sf_dir)
    return _match_out(MT.match_posts(posts, topics, strategy="inverted",
                                     frequencies=MT.token_frequencies(posts, topics)))


@register("match_non_latin")
def match_non_latin(spark, sf_dir):
    """Keywords and posts in Cyrillic letters."""
    return _match_out(MT.match_posts(fx.cyrillic_posts(spark, sf_dir), fx.cyrillic_topics(spark),
                                     strategy="inverted"))


@register("match_since_48h")
def match_since_48h(spark, sf_dir):
    """The 48 h look-back over the stored posts: only its days are listed."""
    return _match_out(MT.match_posts(fx.stored_posts(spark, sf_dir), fx.topics(spark, ""),
                                     cutoff=_cutoff(AS_OF, "sync"), strategy="narrow"))


@register("match_windows")
def match_windows(spark, sf_dir):
    """Posts around certain error events, by windows known at run time only."""
    errors = fx.read_events(spark, sf_dir).where("event_type = 'error' AND value >= 99.9")
    windows = errors.select(F.date_trunc("hour", "ts").alias("since"),
                            (F.date_trunc("hour", "ts") + F.expr("INTERVAL 90 MINUTES")).alias("until"))
    found = PS.read_windows(spark, fx.post_store(spark, sf_dir), windows)
    return present(found.select("event_id", "subreddit", "created_at"))


@register("limit_per_topic")
def limit_per_topic(spark, sf_dir):
    m = MT.match_posts(fx.posts(spark, sf_dir), fx.topics(spark, ""), strategy="inverted")
    return present(MT.limit_per_topic(m, FETCH_CAP).select("topic_id", "event_id", "created_at"))


@register("parse_topics")
def parse_topics(spark, sf_dir):
    t = TO.served_topics(fx.topic_catalog(spark, sf_dir))
    return t.select("seq", F.to_json("cnf").alias("keywords_cnf"),
                    F.to_json("subreddit_list").alias("subreddit_list"),
                    F.col("filters.text").alias("filter_text"),
                    F.col("filters.lang").alias("filter_lang"),
                    F.col("filters.author").alias("filter_author"))


@register("render_cnf")
def render_cnf(spark, sf_dir):
    t = fx.topic_catalog(spark, sf_dir)
    return t.select("seq", RU.render_keywords(F.col("keywords")).alias("query"))


@register("clean_cnf")
def clean_cnf(spark, sf_dir):
    t = fx.topic_catalog(spark, sf_dir)
    c = RU.dedupe_terms(RU.clean_cnf(RU.parse_keywords(F.col("keywords"))))
    return t.select("seq", F.to_json(c).alias("clean"))


@register("slugify")
def slugify(spark, sf_dir):
    return TO.with_topic_ids(fx.topic_catalog(spark, sf_dir)).select("seq", "id")


@register("validate_topics")
def validate_topics(spark, sf_dir):
    valid, rejected = TO.validate_topics(fx.topic_catalog(spark, sf_dir))
    return (valid.select("seq", F.lit(True).alias("valid"))
                 .unionByName(rejected.select("seq", F.lit(False).alias("valid"))))


@register("subreddit_checks")
def subreddit_checks(spark, sf_dir):
    t = fx.topic_catalog(spark, sf_dir)
    subs = RU.parse_csv(F.col("subreddits"), clean=True)
    allowed = RU.parse_csv(F.lit(SRC_0_9), clean=True)
    return t.select("seq", RU.subreddit_count(subs).alias("n_selected"),
                    RU.within_cap(subs).alias("within_cap"),
                    F.to_json(RU.not_allowed(subs, allowed)).alias("not_allowed"))


@register("allowed_search")
def allowed_search(spark, sf_dir):
    """Each topic's subreddits that hold the typed text, in any case."""
    t = fx.topic_catalog(spark, sf_dir)
    subs = RU.parse_csv(F.col("subreddits"), clean=True)
    return t.select("seq", F.to_json(RU.search_allowed(subs, "rC1")).alias("found"))


def _existing_topics(spark):
    base = fx.topics(spark, SRC_0_9).select("id")
    return base.unionByName(spark.createDataFrame([("click",), ("signup",)], "id string"))


@register("append_topics")
def append_topics(spark, sf_dir):
    new = TO.with_topic_ids(fx.topic_catalog(spark, sf_dir))
    out = TO.append_topics(new, _existing_topics(spark), AS_OF)
    return present(out.select("seq", "id", "outcome", "description", "filters_json",
                              "update_frequency_seconds", "created_at", "backfill_status"))


@register("insert_topics")
def insert_topics(spark, sf_dir):
    """Two batches with conflicting ids written to the stored catalogue, the second
    one twice (a replay), and the catalogue read back."""
    path = _os.path.join(scratch_dir(spark, "catalogue"), "topics")
    new = TO.with_topic_ids(fx.topic_catalog(spark, sf_dir))
    odd = F.col("seq") % 3 == 0
    TO.insert_topics(new.where(odd), path, 0, AS_OF)
    for _ in range(2):
        TO.insert_topics(new.where(~odd), path, 1, AS_OF)
    stored = TO.stored_topics(spark, path)
    return present(stored.select("batch", "seq", "id", "description", "filters_json",
                                 "update_frequency_seconds", "created_at", "backfill_status"))


@register("stored_catalogue")
def stored_catalogue(spark, sf_dir):
    """The catalogue scanned from its store, in the form that is served."""
    t = TO.served_topics(TO.read_topics(spark, "parquet", fx.topic_store(spark, sf_dir)))
    return t.select("seq", "id", F.to_json("cnf").alias("keywords_cnf"),
                    F.to_json("subreddit_list").alias("subreddit_list"))


@register("tasks_with_topic")
def tasks_with_topic(spark, sf_dir):
    ev = fx.read_events(spark, sf_dir)
    value = F.when(F.col("event_type") != "error", F.concat(
        F.lit('{"topic_id":"topic-'), (F.col("event_id") * 2).cast("string"),
        F.lit('","subreddits":["src1"]}')))
    tasks = TO.read_tasks(ev.select(value.alias("value"), F.col("event_id").alias("task_seq")))
    topics = TO.with_topic_ids(fx.topic_catalog(spark, sf_dir))
    return TO.classify_tasks(tasks, topics).select("task_seq", "topic_id", "status",
                                                   "description")


# ---------------------------------------------------------------- phase 4


@register("normalize_posts")
def normalize_posts(spark, sf_dir):
    n = NO.normalize_posts(fx.raw_feed(spark, sf_dir), AS_OF)
    return present(n.drop("created_at"))


def _wire_events(spark, sf_dir, task_posts=fx.TASK_POSTS):
    """F1 posts as matched events on the wire; k = 0 rows arrive truncated."""
    p = fx.posts(spark, sf_dir, task_posts).withColumn(
        "created_utc", NO.iso_utc(F.col("created_at"))).drop("created_at", "lang")
    ev = NO.to_matched_events(p.withColumn("topic_id", F.concat(F.lit("topic-"), F.col("subreddit"))))
    good = NO.event_json(ev)
    broken = F.concat(F.lit('{"event_id":"'), F.col("event_id"), F.lit('","score":'))
    return ev.select(F.when(F.col("num_comments") == 0, broken).otherwise(good).alias("value"))


@register("event_json_roundtrip")
def event_json_roundtrip(spark, sf_dir):
    return NO.parse_events(_wire_events(spark, sf_dir), POST_SCHEMA)


@register("event_rejects")
def event_rejects(spark, sf_dir):
    """P1's rejects: broken JSON, a missing key and blank values, with text and reason."""
    wire = _wire_events(spark, sf_dir)
    field = F.get_json_object
    score = field("value", "$.score").cast("int")
    keyless = F.concat(F.lit('{"event_id":"'), field("value", "$.event_id"), F.lit('"}'))
    values = wire.select(F.when(score % 17 == 0, keyless).when(score % 19 == 0, F.lit(" "))
                         .otherwise(F.col("value")).alias("value"))
    return NO.parse_with_rejects(values)[1]


@register("event_time")
def event_time(spark, sf_dir):
    e = NO.parse_events(_wire_events(spark, sf_dir), POST_SCHEMA)
    e = e.withColumn("timestamp", F.when(F.col("score") % 13 == 0, F.lit("not-a-date"))
                                   .otherwise(F.col("timestamp")))
    return present(NO.with_event_time(e, AS_OF).select("event_id", "timestamp", "event_ts"))


@register("sentiment_lexicon")
def sentiment_lexicon(spark, sf_dir):
    s = SE.with_sentiment(fx.posts(spark, sf_dir), SE.default_lexicon(spark))
    return present(s.select("event_id", "sentiment_score"))


@register("current_posts_merge")
def current_posts_merge(spark, sf_dir):
    return present(ST.current_posts(fx.post_log(spark, sf_dir)))


@register("latest_rows")
def latest_rows(spark, sf_dir):
    return present(ST.latest_rows(fx.post_log(spark, sf_dir)))


# ---------------------------------------------------------------- phase 6


_TS_OPTS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
F4_IDS = [t for t, _ in fx.F4_TOPICS]


def _store_wire(spark, sf_dir, path):
    """The wire's events as large files of many row groups, which the tasks of a micro-batch share."""
    _wire_events(spark, sf_dir, fx.FILE_POSTS).write.options(**SPLIT_OPTIONS).parquet(path)


@register("stream_enrich")
def stream_enrich(spark, sf_dir):
    base = scratch_dir(spark, "enrich")
    src, out = _os.path.join(base, "in"), _os.path.join(base, "out")
    _store_wire(spark, sf_dir, src)
    q = EN.enrich_stream(spark, src, out, _os.path.join(base, "ckpt"),
                         source_fmt="parquet", lexicon=SE.default_lexicon(spark),
                         source_options={"maxFilesPerTrigger": 4})
    q.awaitTermination()
    e = EN.read_enriched(spark.read.text(out))
    return present(e.select("event_id", "topic_id", "sentiment_score"))


def _stored_lexicon(spark, sf_dir):
    """F8, written once: every micro-batch reads it."""
    path = _os.path.join(scratch_dir(spark, "lexicon"), "words")
    fx.large_lexicon(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@register("sentiment_large_lexicon")
def sentiment_large_lexicon(spark, sf_dir):
    """U1 with a lexicon beyond the inlined bound: the join plan."""
    s = SE.with_sentiment(fx.posts(spark, sf_dir), _stored_lexicon(spark, sf_dir))
    return present(s.select("event_id", "sentiment_score"))


@register("stream_enrich_large_lexicon")
def stream_enrich_large_lexicon(spark, sf_dir):
    base = scratch_dir(spark, "enrich-large")
    src, out = _os.path.join(base, "in"), _os.path.join(base, "out")
    _store_wire(spark, sf_dir, src)
    EN.enrich_stream(spark, src, out, _os.path.join(base, "ckpt"), source_fmt="parquet",
                     lexicon=_stored_lexicon(spark, sf_dir), source_options={"maxFilesPerTrigger": 4}).awaitTermination()
    e = EN.read_enriched(spark.read.text(out))
    return present(e.select("event_id", "topic_id", "sentiment_score"))


_LOG_DDL = ("topic_id string, event_id string, arrival_ts timestamp, seq long, score int, "
            "num_comments int, sentiment_score double")


@register("stream_upsert")
def stream_upsert(spark, sf_dir):
    base = scratch_dir(spark, "upsert")
    src, log = _os.path.join(base, "in"), _os.path.join(base, "log")
    pl = fx.post_log(spark, sf_dir)
    (pl.repartitionByRange(4, "seq")
       .select(F.to_json(F.struct(*pl.columns), _TS_OPTS).alias("value"))
       .write.text(src))
    stream = (spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(src)
                   .select(F.from_json("value", _LOG_DDL, _TS_OPTS).alias("e")).select("e.*"))
    UP.upsert_stream(stream, log, _os.path.join(base, "ckpt")).awaitTermination()
    cur = UP.current_view(spark, log, order_cols=("arrival_ts", "seq"),
                          value_cols=["score", "num_comments", "sentiment_score"])
    return present(cur)


def _task_values(spark, sf_dir):
    ev = fx.read_events(spark, sf_dir)
    ids = F.array(*[F.lit(t) for t in F4_IDS + ["ghost-topic"]])
    tid = F.element_at(ids, (F.col("event_id") % len(F4_IDS + ["ghost-topic"]) + 1).cast("int"))
    return ev.select(F.concat(F.lit('{"topic_id":"'), tid,
                              F.lit('","subreddits":["src1"]}')).alias("value"),
                     F.col("event_id").alias("seq"))


@register("backfill_run")
def backfill_run(spark, sf_dir):
    base = scratch_dir(spark, "backfill")
    src, out = _os.path.join(base, "tasks"), _os.path.join(base, "out")
    _task_values(spark, sf_dir).repartitionByRange(3, "seq").select("value").write.text(src)
    q = BF.run_backfill(spark, src, fx.topics(spark, ""), fx.stored_posts(spark, sf_dir), AS_OF, out,
                        _os.path.join(base, "ckpt"), source_options={"maxFilesPerTrigger": 1})
    q.awaitTermination()
    res = UP.read_log(spark, _os.path.join(out, "events"))
    return present(res.select("topic_id", "event_id", "created_at").distinct())


@register("backfill_status")
def backfill_status(spark, sf_dir):
    """T3 → T4: the status that a backfill run wrote, and the tasks it rejected."""
    base = scratch_dir(spark, "backfill-status")
    src, out = _os.path.join(base, "tasks"), _os.path.join(base, "out")
    _task_values(spark, sf_dir).repartitionByRange(2, "seq").select("value").write.text(src)
    BF.run_backfill(spark, src, fx.topics(spark, ""), fx.stored_posts(spark, sf_dir), AS_OF, out,
                    _os.path.join(base, "ckpt")).awaitTermination()
    status = BF.status_of(BF.read_status(spark, out))
    rejected = spark.read.parquet(_os.path.join(out, "rejects")).groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("rejected"))
    return status.select("topic_id", "status", "percentage").join(
        rejected, "topic_id", "full").select("topic_id", "status", "percentage", "rejected")


@register("backfill_steps")
def backfill_steps(spark, sf_dir):
    """Every status event of one backfill, with what its job observed."""
    base = scratch_dir(spark, "backfill-steps")
    src, out = _os.path.join(base, "tasks"), _os.path.join(base, "out")
    _task_values(spark, sf_dir).select("value").write.text(src)
    BF.run_backfill(spark, src, fx.topics(spark, ""), fx.stored_posts(spark, sf_dir), AS_OF, out,
                    _os.path.join(base, "ckpt")).awaitTermination()
    return present(BF.read_status(spark, out))


@register("backfill_progress")
def backfill_progress(spark, sf_dir):
    m = MT.match_posts(fx.posts(spark, sf_dir), fx.topics(spark, ""),
                       cutoff=_cutoff(AS_OF, "backfill"), strategy="narrow")
    return present(BF.backfill_progress(m, AS_OF))


@register("topic_status")
def topic_status(spark, sf_dir):
    ev = fx.read_events(spark, sf_dir)
    ids = F.array(*[F.lit(t) for t in F4_IDS])
    i = F.col("event_id")
    events = ev.select(
        F.element_at(ids, (i % len(F4_IDS) + 1).cast("int")).alias("topic_id"),
        F.when(i % 3 == 0, F.lit("PENDING")).when(i % 3 == 2, F.lit("COMPLETED"))
         .alias("status"),
        F.when(i % 3 == 1, F.col("value")).alias("percentage"),
        i.alias("seq"))
    return present(BF.status_of(events))


# ---------------------------------------------------------------- phase 7

# Stored filters of the filtered-topic fixture.
F4_FILTERS = {"cnf-two": '{"lang":"en"}', "phrase": '{"text":"Best"}',
              "flat": '{"lang":"FR","author":"u_7"}'}


def filtered_topics(spark):
    t = fx.topics(spark, "")
    m = F.create_map(*[x for kv in F4_FILTERS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return t.withColumn("filters_json", F.coalesce(F.element_at(m, F.col("id")), F.lit("{}")))


@register("sentiment_split")
def sentiment_split(spark, sf_dir):
    return present(EX.sentiment_split(fx.topic_posts(spark, sf_dir)))


@register("top_keywords")
def top_keywords(spark, sf_dir):
    m = MT.match_posts(fx.posts(spark, sf_dir), fx.topics(spark, ""), strategy="auto",
                       tokens_col="tokens")
    return present(EX.top_keywords(m, 5, tokens_col="tokens"))


@register("top_keywords_arrays")
def top_keywords_arrays(spark, sf_dir):
    """X2 in its declared shape: one array of (key, doc_count) per bucket."""
    m = MT.match_posts(fx.posts(spark, sf_dir), fx.topics(spark, ""), strategy="auto",
                       tokens_col="tokens")
    arrays = EX.top_keywords_arrays(EX.top_keywords(m, 5, tokens_col="tokens"))
    return present(arrays.withColumn("top_keywords", F.to_json("top_keywords")))


@register("topic_filters")
def topic_filters(spark, sf_dir):
    t = filtered_topics(spark)
    m = MT.match_posts(fx.posts(spark, sf_dir), t, strategy="narrow")
    return _match_out(EX.apply_topic_filters(m, t))


# ---------------------------------------------------------------- remaining inventory

PICKED = ["click", "view"]


@register("kpis_picked")
def kpis_picked(spark, sf_dir):
    return present(D.kpis(fx.topic_posts(spark, sf_dir), AS_OF, topics=PICKED))


@register("backfill_tasks")
def backfill_tasks(spark, sf_dir):
    topics = TO.with_topic_ids(fx.topic_catalog(spark, sf_dir))
    return TO.backfill_tasks(topics.select("id"), SRC_0_9 + ", ,src3 ")


@register("raw_feed_json")
def raw_feed_json(spark, sf_dir):
    """S9 + P3: the raw feed stored as JSON files, read back and normalised."""
    path = _os.path.join(scratch_dir(spark, "rawfeed"), "feed")
    fx.raw_feed(spark, sf_dir).write.options(**TEXT_OPTIONS).json(path)
    n = NO.normalize_posts(read_raw_posts(spark, path), AS_OF)
    return present(n.drop("created_at"))


@register("sync_resend")
def sync_resend(spark, sf_dir):
    """Two re-send cycles an hour apart; the second carries fresh scores."""
    import datetime as _dt2
    log = _os.path.join(scratch_dir(spark, "sync"), "log")
    posts = fx.stored_posts(spark, sf_dir)       # each cycle lists the days of its 48 h only
    topics = fx.topics(spark, "")
    SY.sync_cycle(posts, topics, AS_OF - _dt2.timedelta(hours=1), log, 0, strategy="narrow")
    fresh = posts.withColumn("score", F.col("score") + F.lit(1))
    SY.sync_cycle(fresh, topics, AS_OF, log, 1, strategy="narrow")
    cur = UP.current_view(spark, log, value_cols=["score", "engagement", "created_at"])
    return present(cur.select("topic_id", "event_id", "score", "engagement", "created_at",
                              "versions"))


@register("pipeline_report")
def pipeline_report(spark, sf_dir):
    """The connected stream: match → JSON events → enrich stream → consumer stream →
    upsert log → current view → report, over two cycles; the second re-sends every
    post with its fresh score."""
    base = scratch_dir(spark, "flow")
    matched, enriched, log = (_os.path.join(base, x) for x in ("matched", "enriched", "log"))
    topics = fx.topics(spark, "")
    posts = fx.posts(spark, sf_dir)
    stale = posts.withColumn("score", F.col("score") - F.lit(1))
    for n, cycle in enumerate((stale, posts)):
        SY.publish_cycle(cycle, topics, AS_OF, matched, n, preset=None)
        EN.enrich_stream(spark, matched, enriched, _os.path.join(base, "ckpt-enrich"),
                         source_options={"recursiveFileLookup": "true"}).awaitTermination()
        events = EN.read_enriched(EN.read_posts_stream(spark, "text", enriched))
        UP.upsert_stream(events, log, _os.path.join(base, "ckpt-upsert")).awaitTermination()
    cur = UP.current_view(spark, log, value_cols=["event_ts", "engagement", "sentiment_score"])
    return present(M.report(cur.withColumnRenamed("event_ts", "created_at"), AS_OF,
                            topics=topics.select(F.col("id").alias("topic_id"))))


# ---------------------------------------------------------------- more ranges, S6, U2
@register("timeline_1w_this_month")
def timeline_1w_this_month(spark, sf_dir):
    return present(TL.timeline(_report_all(spark, sf_dir), "1w", "this_month", AS_OF))


@register("timeline_1m_6m")
def timeline_1m_6m(spark, sf_dir):
    return present(TL.timeline(_report_all(spark, sf_dir), "1m", "6m", AS_OF))


@register("summary_12m")
def summary_12m(spark, sf_dir):
    return present(TL.summary(_report_all(spark, sf_dir), "12m", AS_OF))


def _register_timeline(window_type: str, range_name: str) -> None:
    @register(f"timeline_{window_type}_{range_name}")
    def query(spark, sf_dir):
        return present(TL.timeline(_report_all(spark, sf_dir), window_type, range_name, AS_OF))


for _w, _r in (("1d", "3m"), ("1d", "this_month"), ("1w", "6m"), ("1m", "3m")):
    _register_timeline(_w, _r)


@register("summary_this_week")
def summary_this_week(spark, sf_dir):
    return present(TL.summary(_report_all(spark, sf_dir), "this_week", AS_OF))


@register("topic_by_id")
def topic_by_id(spark, sf_dir):
    """A point lookup on the stored catalogue; the id reaches the scan."""
    t = TO.read_topics(spark, "parquet", fx.topic_store(spark, sf_dir))
    return present(TO.topic_by_id(t, "topic-40").select("seq", "id", "description", "keywords",
                                                         "subreddits"))


@register("sentiment_model")
def sentiment_model(spark, sf_dir):
    s = SE.with_model_sentiment(fx.posts(spark, sf_dir), SE.lexicon_model_factory())
    return present(s.select("event_id", "sentiment_score"))


# ---------------------------------------------------------------- end to end
@register("topic_trends")
def topic_trends(spark, sf_dir):
    """Posts → CNF match → engagement + lexicon sentiment → gap-filled report.

    Every catalogue topic gets a series, with or without matches.
    """
    topics = fx.topics(spark, "")
    matched = MT.match_posts(fx.posts(spark, sf_dir), topics, strategy="auto")
    scored = SE.with_sentiment(matched, SE.default_lexicon(spark))
    r = M.report(scored, AS_OF, topics=topics.select(F.col("id").alias("topic_id")))
    return present(r)


@register("report_from_log")
def report_from_log(spark, sf_dir):
    """Report over the upsert log's current view (re-sent posts count once).

    Batch 0 carries every post with a stale engagement, batch 1 re-sends it
    with the fresh value; the current view keeps one row per post with the
    newest values, and the report over it equals the report over the posts.
    """
    log = _os.path.join(scratch_dir(spark, "reportlog"), "log")
    tp = fx.topic_posts(spark, sf_dir)
    UP.log_batch(tp.withColumn("engagement", F.col("engagement") - F.lit(1)), 0, log)
    UP.log_batch(tp, 1, log)
    cur = UP.current_view(spark, log, value_cols=["created_at", "engagement", "sentiment_score"])
    return present(M.report(cur, AS_OF))


@register("report_incremental")
def report_incremental(spark, sf_dir):
    """The report kept by the trends stream over three re-send cycles.

    The first cycle carries every post with stale figures, the second re-sends
    the newer half of the month without sentiment, the third all posts with
    their final figures but no sentiment where the first already had it.
    """
    base = scratch_dir(spark, "trends")
    src, out = _os.path.join(base, "in"), _os.path.join(base, "out")
    tp = fx.topic_posts(spark, sf_dir).select("topic_id", "event_id", "created_at", "engagement",
                                              "sentiment_score")
    none = F.lit(None).cast("double")
    cycles = [tp.withColumn("engagement", F.col("engagement") - 2),
              tp.where(F.col("created_at") >= F.lit(dt.datetime(2024, 1, 16))).withColumn(
                  "engagement", F.col("engagement") - 1).withColumn("sentiment_score", none),
              tp.withColumn("sentiment_score", none)]
    for c in cycles:                # each cycle's files are one micro-batch of the resumed stream
        c.write.mode("append").parquet(src)
        stream = spark.readStream.schema(tp.schema).parquet(src)
        TR.trends_stream(stream, out, _os.path.join(base, "ckpt")).awaitTermination()
    return present(TR.report_now(spark, out, AS_OF))
