"""What the large-table findings of round 3 asked for: where texts are shuffled, stored and read."""

import datetime as dt
import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from tests.test_matching import TOPIC_DDL, _rows
from tests.test_plans import _plan

from topicpulse.functions import sentiment as SE
from topicpulse.operators import extras as EX
from topicpulse.operators import matching as MT
from topicpulse.plans.catalog import REGISTRY
from topicpulse.session import SPLIT_OPTIONS
from topicpulse.sources import fixtures as fx
from topicpulse.sources import poststore as PS
from topicpulse.streaming import enrich as EN
from topicpulse.streaming import upsert as UP

DAY = dt.datetime(2024, 1, 20)


@pytest.fixture(scope="module")
def tables(spark):
    """3,000 events over 40 documents."""
    path = tempfile.mkdtemp(prefix="topicpulse-scale-")
    ev = spark.range(3000).select(
        F.col("id").alias("event_id"),
        (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 9000).cast("int")))
        .alias("ts"), (F.col("id") % 50).alias("user_id"),
        F.when(F.col("id") % 2 == 0, "click").otherwise("error").alias("event_type"),
        (F.col("id") % 100).cast("double").alias("value"),
        F.format_string('{"k": %d}', F.col("id") % 7).alias("props"))
    ev.repartition(4).write.parquet(os.path.join(path, "events.parquet"))
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("best thing "), F.repeat(F.lit("of the good words "), (F.col("id") + 1).cast("int"))).alias("text"),
        F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(9).alias("n_chars"))
    docs.write.parquet(os.path.join(path, "documents.parquet"))
    return path


def test_feed_deals_events_and_never_texts(spark, tables):
    """the text is joined last and passes no exchange."""
    posts = fx.posts(spark, tables)
    plan = _plan(posts)
    assert "hashpartitioning(event_id" not in plan
    assert posts.rdd.getNumPartitions() > 1
    got = {r.event_id: (r.text, r.score, r.num_comments) for r in posts.collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert got == {f"t3_{i}": (texts[i % 40], i % 100, i % 7) for i in range(3000)}


def test_stored_texts_are_compressed(spark, tables):
    """The post store and the event log."""
    base = tempfile.mkdtemp(prefix="topicpulse-scale-")
    posts = fx.posts(spark, tables)
    PS.write_posts(posts, f"{base}/store")
    UP.log_batch(posts.withColumn("topic_id", F.lit("t")).withColumn("event_ts", F.col("created_at")), 0, f"{base}/log")
    for at in ("store", "log"):
        files = glob.glob(f"{base}/{at}/**/part-*", recursive=True)
        assert files and all(f.endswith(".zstd.parquet") for f in files)
        assert spark.read.parquet(f"{base}/{at}").count() == 3000


def test_lines_with_texts_are_compressed(spark):
    """events on the wire and the enriched stream's files."""
    base = tempfile.mkdtemp(prefix="topicpulse-scale-")
    spark.createDataFrame([('{"event_id":"a","topic_id":"t","text":"best"}',)], "value string").write.text(f"{base}/in")
    EN.enrich_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt").awaitTermination()
    files = glob.glob(f"{base}/out/**/part-*", recursive=True)
    assert files and all(f.endswith(".gz") for f in files)
    assert [r.sentiment_score for r in EN.read_enriched(spark.read.text(f"{base}/out")).collect()] == [1.0]


def test_cap_never_deals_matches_by_topic(spark, monkeypatch):
    """matches meet their topic's last key where they lie; many topics by salted topics."""
    rows = [(t, f"e{i}", DAY + dt.timedelta(seconds=i // 3), "x" * 50) for t in ("a", "b", None) for i in range(400)]
    m = spark.createDataFrame(rows, "topic_id string, event_id string, created_at timestamp, text string")

    def newest(df):
        return sorted((r.topic_id or "", r.event_id) for r in df.collect())

    want = sorted((t or "", e) for t in ("a", "b", None) for _, _, e in sorted(
        (-(i // 3), f"e{i}", f"e{i}") for i in range(400))[:100])
    broadcast = MT.limit_per_topic(m, 100)
    assert "SortMergeJoin" not in _plan(broadcast) and "hashpartitioning(topic_id" not in _plan(broadcast)
    assert newest(broadcast) == want
    monkeypatch.setattr(MT, "LIMIT_BROADCAST_TOPICS", 0)
    assert newest(MT.limit_per_topic(m, 100)) == want


def test_cycles_are_written_in_parallel(spark, tables):
    """a cycle of the trends stream is one batch of as many files as the events have tasks."""
    before = set(glob.glob(os.path.join(spark.conf.get("spark.checkpoint.dir"), "trends-*")))
    REGISTRY["report_incremental"](spark, tables).collect()
    base, = set(glob.glob(os.path.join(spark.conf.get("spark.checkpoint.dir"), "trends-*"))) - before
    assert len(glob.glob(f"{base}/in/part-*")) > 3
    assert sorted(os.path.basename(p) for p in glob.glob(f"{base}/out/state/batch=*")) == [f"batch={i}" for i in range(3)]


def test_rejects_parse_a_value_once(spark, tables):
    """the plan of the rejects holds one JSON parse."""
    rejects = REGISTRY["event_rejects"](spark, tables)
    assert _plan(rejects).count("from_json(") == 1
    reasons = {r.reason: r.n for r in rejects.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    scores = [(i % 100, i % 7) for i in range(3000)]
    whole = [s for s, k in scores if k]
    assert reasons["no topic_id"] == sum(s % 17 == 0 for s in whole)
    assert reasons["empty"] == sum(s % 17 != 0 and s % 19 == 0 for s in whole)


def test_feed_runs_in_many_tasks_over_one_file_of_documents(spark):
    """Few events are not broadcast to the scan of the documents."""
    path = tempfile.mkdtemp(prefix="topicpulse-scale-")
    ev = spark.range(9000).select(
        F.col("id").alias("event_id"), F.lit(DAY).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    ev.write.parquet(f"{path}/events.parquet")
    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256) for i in range(8)])
    spark.range(5000).coalesce(1).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"),
    ).write.parquet(f"{path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
    try:
        posts = fx.posts(spark, path)
        assert posts.select(F.spark_partition_id().alias("p"), F.length("text")).groupBy("p").count().count() > 1
        assert posts.count() == 9000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_inverted_plan_shuffles_no_post(spark, tables):
    """hits are verified where they lie, in a plan without an aggregate by post."""
    plan = _plan(MT.match_posts(fx.posts(spark, tables), fx.topics(spark, ""), strategy="inverted"))
    assert "_row" not in plan and "hashpartitioning(monotonically" not in plan


@pytest.mark.parametrize("literal, broadcast", [(512, 1 << 25), (0, 1 << 25), (0, 0)])
def test_many_phrases_give_the_same_rows(spark, monkeypatch, literal, broadcast):
    """phrases keyed by neighbouring runs, one group looked up, the others verified."""
    rnd = random.Random(5)
    vocab = ["foo", "bar", "of", "the", "of the", "big data", "big  data", "foo of the bar", "of the big-data", "c++",
             "!!", "x-ray", "the the"]
    texts = [(None if i % 9 == 0 else f"p{i % 70}", None if i % 50 == 0 else
              " ".join(rnd.choice(vocab + ["q"]) for _ in range(rnd.randint(0, 9))), rnd.choice(["a", "B", None]))
             for i in range(200)]
    topics = [(f"t{j}", str([[rnd.choice(vocab) for _ in range(rnd.randint(1, 3))]
                             for _ in range(rnd.randint(1, 3))]).replace("'", '"'), rnd.choice(["", "a"]))
              for j in range(40)]
    posts = spark.createDataFrame(texts, "event_id string, text string, subreddit string").withColumn(
        "created_at", F.lit(DAY)).repartition(3)
    tdf = spark.createDataFrame(topics, TOPIC_DDL)
    want = _rows(MT.match_posts(posts, tdf, strategy="narrow"))
    monkeypatch.setattr(MT, "PAIR_MIN_PHRASES", 1)
    monkeypatch.setattr(MT, "LITERAL_MAX_KEYS", literal)
    monkeypatch.setattr(MT, "BROADCAST_MAX_BYTES", broadcast)
    freq = MT.token_frequencies(posts, tdf)
    assert len(want) > 200
    assert _rows(MT.match_posts(posts, tdf, strategy="inverted", frequencies=freq)) == want


def test_narrow_groups_share_one_pass_over_the_tokens(spark, tables):
    """The groups compare the few listed words of a post, and posts that
    no topic's subreddits hold are dropped before they are tokenised."""
    posts = fx.posts(spark, tables)
    plan = _plan(MT.match_posts(posts, fx.topics(spark, "src1,src2"), strategy="narrow"))
    assert "array_intersect(" in plan and "arrays_overlap(_tp_words" in plan
    assert "lower(subreddit" in plan and " IN (src1,src2)" in plan


@pytest.mark.parametrize("searched", [16, 0])
def test_few_words_are_searched_without_tokens(spark, monkeypatch, searched):
    """Few listed words are searched in the text, which is split only for
    the tokens of matching posts; the rows are those of the comparison by tokens."""
    texts = ["best", "Best.", "xbest", "best3", "\U0001D400best", "best\U0001D400", "\U0001F600best\U0001F600",
             "bestbest best", "c++", "xc++", "\U0001D400c++", "of the", "of  the", "\U0001D400of the", None, ""]
    posts = spark.createDataFrame(list(enumerate(texts)), "event_id long, text string").withColumns(
        {"created_at": F.lit(DAY), "subreddit": F.lit("a")})
    topics = spark.createDataFrame([("w", '["best","c++"]', ""), ("p", '[["of the"]]', "A")], TOPIC_DDL)
    monkeypatch.setattr(MT, "SEARCH_MAX_WORDS", searched)
    got = MT.match_posts(posts, topics, strategy="narrow")
    assert ("split(" in _plan(got)) == (searched == 0)
    assert sorted((r.topic_id, r.event_id) for r in got.collect()) == [("p", 11), *[("w", i) for i in (0, 1, 6, 7, 8)]]
    tokens = {r.event_id: r.tokens for r in MT.match_posts(posts, topics, strategy="narrow", tokens_col="tokens").collect()}
    assert tokens == {0: ["best"], 1: ["best", ""], 6: ["", "best", ""], 7: ["bestbest", "best"], 8: ["c", ""],
                      11: ["of", "the"]}


def test_large_lexicon_deals_only_what_is_asked_for(spark):
    """F16: the join plan shuffles no text that the caller drops; rows with nulls and copies return whole."""
    lexicon = spark.createDataFrame([(f"w{i}", i / 300, 1.0, i % 50 == 0) for i in range(300)]
                                    + [("very", None, 1.5, False)], SE.LEXICON_SCHEMA)
    rows = [("a", "w30 x w60", None), ("a", "w30 x w60", None), (None, "very w30", 1), ("c", None, 2), ("d", "", 3),
            ("e", "w50 w30", 4)]
    posts = spark.createDataFrame(rows, "event_id string, text string, n int")
    scored = SE.with_sentiment(posts, lexicon)
    asked = _plan(scored.select("event_id", "sentiment_score")).count("first(")
    assert 0 < 3 * asked == _plan(scored).count("first(")
    want = [0.15, 0.15, 0.15, 0.0, 0.0, (50 / 300 - 0.05) / 2]     # w0 and w50 negate
    got = scored.collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(rows, key=str)
    scores = {tuple(r)[:3]: r.sentiment_score for r in got}
    assert all(abs(scores[r] - w) < 1e-6 for r, w in zip(rows, want, strict=True))


def test_small_lexicon_scores_tokens_once(spark):
    """the tokens of a post are gone through once, not for their sum and their number each."""
    scored = SE.with_sentiment(spark.createDataFrame([("best x good",), ("x",)], "text string"),
                               SE.default_lexicon(spark))
    assert _plan(scored).count("transform(") == 1
    assert [round(r.sentiment_score, 6) for r in scored.collect()] == [0.85, 0.0]


def test_day_of_a_post_is_made_once(spark):
    """the day is a column of the post under the explode of its tokens."""
    m = spark.createDataFrame([("t", DAY, "b a a"), ("t", DAY, "b")], "topic_id string, created_at timestamp, text string")
    top = EX.top_keywords(m, 2)
    made, = (line for line in _plan(top).splitlines() if "explode(array_distinct" in line)
    assert "day#" in made
    assert {(r["rank"], r["key"], r.doc_count) for r in top.collect()} == {(1, "b", 2), (2, "a", 1)}


def test_catalogue_is_kept_once_a_rule(spark, monkeypatch):
    """r04 F1: the lookup table holds a rule once for all its topics and no regexes, so that it is broadcast
    and posts are not dealt with their hits."""
    topics = [(f"t{j}", [[f"foo bar w{j // 3}", f"of the v{j // 3}"], [f"a{j // 3}", "one", "two"]], [])
              for j in range(240)]
    texts = [f"x foo bar w{i}, of the v{i + 1} {w}" for i in range(100) for w in ("two", "three", f"a{i}")]
    posts = spark.createDataFrame(list(enumerate(texts)), "event_id long, text string").withColumns(
        {"created_at": F.lit(DAY), "subreddit": F.lit("a")})
    tdf = spark.createDataFrame(topics, "topic_id string, cnf array<array<string>>, subs array<string>")
    table = MT.lookup_table(MT.term_table(tdf))
    assert table.count() == 160 and table.agg(MT._bytes()).first()[0] < 240 * 250
    monkeypatch.setattr(MT, "BROADCAST_MAX_BYTES", 240 * 250)
    got = MT.match_posts(posts, tdf, strategy="inverted")
    assert "_row" not in _plan(got)
    assert _rows(got) == _rows(MT.match_posts(posts, tdf, strategy="narrow")) and got.count() > 600


def test_store_is_written_by_the_tasks_of_the_join(spark, tables):
    """r04 F2, F3, F6, F7: no exchange of whole posts by day; a day's files are those of the join's tasks, in
    which all posts of one document lie together."""
    stored = fx.stored_posts(spark, tables).withColumn("file", F.input_file_name())
    days = stored.groupBy("event_date").agg(F.count_distinct("file").alias("files"), F.count("*").alias("posts"))
    assert all(r.files > 1 for r in days.collect()) and days.agg(F.sum("posts")).first()[0] == 3000
    texts = stored.groupBy("event_date", "text").agg(F.count_distinct("file").alias("files"))
    assert texts.where("files > 1").count() == 0
    assert sorted(map(str, stored.drop("event_date", "file").collect())) == sorted(map(str, fx.posts(spark, tables).collect()))


def test_stored_wire_is_shared_by_many_tasks(spark, tables):
    """r04 F4, F5: one compressed file of events is read, scored and written by several tasks."""
    base = tempfile.mkdtemp(prefix="topicpulse-scale-")
    text = F.concat(F.lit("best "), F.sha2(F.col("id").cast("string"), 256))
    events = spark.range(20000).select(F.to_json(F.struct(F.col("id").cast("string").alias("event_id"), text.alias("text")))
                                       .alias("value"))
    events.coalesce(1).write.options(**SPLIT_OPTIONS).parquet(f"{base}/in")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        EN.enrich_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", source_fmt="parquet").awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(glob.glob(f"{base}/out/batch_id=0/part-*")) > 2
    rows = EN.read_enriched(spark.read.text(f"{base}/out"))
    assert rows.count() == rows.select("event_id").distinct().count() == 20000
    assert rows.where("sentiment_score = 1").count() == 20000
    for name in ("stream_enrich", "stream_enrich_large_lexicon"):
        assert REGISTRY[name](spark, tables).count() == 3000


def test_texts_without_polar_words_are_not_tokenised(spark, monkeypatch):
    """r04 F4: the few polar words are searched first; the scores are those of the tokens."""
    texts = ["Best!", "bestow the rest", "\U0001D400best", "\U0001F600best\U0001F600", "not best, thing", "", None, "badly bad"]
    posts = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    scored = SE.with_sentiment(posts, SE.default_lexicon(spark))
    assert "contains(" in _plan(scored).lower()
    got = {r.n: r.sentiment_score for r in scored.collect()}
    monkeypatch.setattr(SE, "SEARCH_MAX_WORDS", 0)
    assert got == {r.n: r.sentiment_score for r in SE.with_sentiment(posts, SE.default_lexicon(spark)).collect()}
    assert [round(got[i], 6) for i in range(8)] == [1.0, 0.0, 0.0, 1.0, -0.2, 0.0, 0.0, -0.7]
