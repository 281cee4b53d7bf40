from pyspark.sql import functions as F

from topicpulse.functions import rules as R
from topicpulse.functions.scalars import backfill_progress, clamp, js_round, sentiment_label
from topicpulse.operators import topics as TO
from topicpulse.sources import fixtures as fx


def _one(spark, expr, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first().r


def test_parse_keywords_shapes(spark):
    kw = F.col("v")
    assert _one(spark, R.parse_keywords(kw), '[["a","b"],["c"]]') == [["a", "b"], ["c"]]
    assert _one(spark, R.parse_keywords(kw), '["a","b"]') == [["a", "b"]]
    assert _one(spark, R.parse_keywords(kw), "[]") == []
    assert _one(spark, R.parse_keywords(kw), "thing") is None
    assert _one(spark, R.parse_keywords(kw), None) is None


def test_render_keywords(spark):
    kw = F.col("v")
    assert _one(spark, R.render_keywords(kw), '[["a b","c"],["d"]]') == '("a b" OR c) AND (d)'
    assert _one(spark, R.render_keywords(kw), '["x","y z"]') == 'x OR "y z"'
    assert _one(spark, R.render_keywords(kw), "[]") == ""
    assert _one(spark, R.render_keywords(kw), "raw text") == ""
    assert _one(spark, R.render_keywords(kw), '[["a"],[]]') == "(a) AND ()"


def test_clean_and_dedupe(spark):
    c = R.dedupe_terms(R.clean_cnf(R.parse_keywords(F.col("v"))))
    assert _one(spark, c, '[["a"," ","a "," a"],[],["  "],["b","b"]]') == [["a"], ["b"]]


def test_csv_and_filters(spark):
    assert _one(spark, R.parse_csv(F.col("v")), "a, b,,c") == ["a", " b", "", "c"]
    assert _one(spark, R.parse_csv(F.col("v"), clean=True), "a, b,,c ") == ["a", "b", "c"]
    assert _one(spark, R.parse_csv(F.col("v")), None) == [""]
    f = _one(spark, R.parse_filters(F.col("v")), None)
    assert (f.text, f.lang, f.author) == (None, None, None)
    assert _one(spark, R.parse_filters(F.col("v")), '{"lang":"en"}').lang == "en"


def test_slug_rules(spark):
    long_src = "The Quick, Brown Fox -- jumps over the lazy dog!!"
    rows = [("good-id", '["x"]', "d"), (None, '[["Hello World"]]', "desc"),
            ("my-topic-id-1", "[]", " Desc With Spaces "), ("Has Upper", None, long_src)]
    df = spark.createDataFrame(rows, "id string, keywords string, description string")
    out = [r.id for r in TO.with_topic_ids(df).collect()]
    assert out[0] == "good-id"
    assert out[1] == "hello-world"
    assert out[2] == "desc-with-spaces"
    assert out[3] == "the-quick-brown-fox-jumps-over"[:30]
    assert len(out[3]) == 30


def test_subreddit_cap_and_allowed(spark):
    subs = ",".join(f"s{i}" for i in range(31))
    s = R.parse_csv(F.col("v"), clean=True)
    assert _one(spark, R.subreddit_count(s), subs) == 31
    assert _one(spark, R.within_cap(s), subs) is False
    assert _one(spark, R.within_cap(s), "a,b") is True
    allowed = F.array(F.lit("Python"), F.lit("rust"), F.lit("PyTorch"))
    assert _one(spark, R.search_allowed(allowed, "py"), "x") == ["Python", "PyTorch"]
    assert _one(spark, R.not_allowed(s, allowed), "rust,go,go") == ["go"]


def test_labels_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in (-0.05, -0.049, 0.0, 0.049, 0.05)], "v double")
    got = [r.l for r in df.select(sentiment_label(F.col("v")).alias("l")).collect()]
    assert got == ["Negative", "Neutral", "Neutral", "Neutral", "Positive"]


def test_clamp_round_progress(spark):
    import datetime as dt
    assert _one(spark, clamp(F.col("v"), 0, 100), 150.0, "v double") == 100.0
    assert _one(spark, js_round(F.col("v")), -2.5, "v double") == -2
    as_of = fx.AS_OF
    cut = as_of - dt.timedelta(days=30)
    mid = as_of - dt.timedelta(days=15)
    assert _one(spark, backfill_progress(F.col("v"), as_of, cut), mid, "v timestamp") == 50
    old = as_of - dt.timedelta(days=60)
    assert _one(spark, backfill_progress(F.col("v"), as_of, cut), old, "v timestamp") == 100


def test_validate_append_and_tasks(spark):
    import datetime as dt
    rows = [(1, "a", "d", '["x"]', "s1", None, None),
            (2, None, "d", '["x"]', "s1", None, None),      # missing id
            (3, "b", "d", None, "s1", None, None),          # missing keywords
            (4, "c", "d", '["x"]', "", None, None),         # empty subreddits
            (5, "a", None, '["y"]', "s2", '{"lang":"en"}', 30),  # duplicate in batch
            (6, "old", "d", '["x"]', "s1", None, None)]     # already stored
    df = spark.createDataFrame(rows, "seq long, id string, description string, keywords string, "
                                     "subreddits string, filters_json string, "
                                     "update_frequency_seconds int")
    existing = spark.createDataFrame([("old",)], "id string")
    out = {r.seq: r for r in TO.append_topics(df, existing, fx.AS_OF).collect()}
    assert [out[i].outcome for i in range(1, 7)] == [
        "inserted", "invalid", "invalid", "invalid", "duplicate", "duplicate"]
    assert out[1].filters_json == "{}" and out[1].update_frequency_seconds == 60
    assert out[1].backfill_status == "IDLE" and out[1].created_at == dt.datetime(2024, 1, 31, 12)
    assert out[5].description == ""

    tasks = spark.createDataFrame([('{"topic_id":"a","subreddits":["x"]}',),
                                   ('{"topic_id":"zzz"}',), (None,)], "value string")
    acc, rej = TO.tasks_with_topic(TO.read_tasks(tasks), df.where("seq = 1"))
    assert [r.topic_id for r in acc.collect()] == ["a"]
    assert sorted((r.topic_id or "") for r in rej.collect()) == ["", "zzz"]


def test_read_topics_from_files_and_point_lookup(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="tp-topics-") + "/catalog"
    fx.topics(spark, "src1, src2").write.json(path)
    t = TO.read_topics(spark, "json", path)
    served = {r.id: r for r in TO.served_topics(t).collect()}
    assert served["cnf-two"].cnf == [["thble", "thing"], ["attion", "erble"]]
    assert served["flat"].cnf == [["best", "thanedble"]]
    assert served["raw-text"].cnf is None and served["no-rules"].cnf == []
    assert served["flat"].subreddit_list == ["src1", " src2"]
    assert [r.id for r in TO.topic_by_id(t, "phrase").collect()] == ["phrase"]
