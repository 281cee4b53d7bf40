import datetime as dt
import random
import re

from pyspark.sql import functions as F

from topicpulse.functions.calendar import cutoff
from topicpulse.operators import matching as MT
from topicpulse.sources import fixtures as fx
from tests.conftest import SF001
from tests.test_plans import _count, _plan

TOPIC_DDL = "id string, keywords string, subreddits string"


def _brute(texts, topics):
    out = set()
    for eid, text, sub in texts:
        lt = (text or "").lower()
        for tid, kw, subs in topics:
            import json
            try:
                v = json.loads(kw)
            except (ValueError, TypeError):
                continue
            if not isinstance(v, list) or not v:
                continue
            cnf = v if isinstance(v[0], list) else [v]
            if any(len(g) == 0 for g in cnf):
                continue
            allowed = [s.strip().lower() for s in (subs or "").split(",") if s.strip()]
            if allowed and sub.lower() not in allowed:
                continue
            ok = all(any(re.search(r"(^|[\W_])" + re.escape(t.lower()) + r"([\W_]|$)", lt)
                         for t in g) for g in cnf)
            if ok:
                out.add((tid, eid))
    return out


def test_plans_agree_with_brute_force(spark):
    rnd = random.Random(7)
    vocab = ["alpha", "beta", "gamma", "delta", "c++", "e-mail", "of", "the", "big data"]
    texts = []
    for i in range(300):
        words = [rnd.choice(vocab + ["x", "y", "z"]) for _ in range(rnd.randint(0, 12))]
        sep = rnd.choice([" ", ", ", "  ", ".", "\n"])
        texts.append((f"p{i}", sep.join(words).upper() if i % 5 == 0 else sep.join(words),
                      rnd.choice(["A", "b", "c"])))
    texts.append(("pnull", None, "a"))
    topics = []
    for j in range(25):
        groups = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 3))]
                  for _ in range(rnd.randint(1, 3))]
        kw = str(groups).replace("'", '"') if j % 4 else str(groups[0]).replace("'", '"')
        topics.append((f"t{j}", kw, rnd.choice(["", "a", "a,B", " c , "])))
    topics += [("none", "[]", ""), ("empty", '[["alpha"],[]]', ""), ("raw", "alpha", "")]
    posts = spark.createDataFrame(texts, "event_id string, text string, subreddit string") \
        .withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    tdf = spark.createDataFrame(topics, TOPIC_DDL)
    want = _brute(texts, topics)
    for strategy in ("narrow", "inverted"):
        got = {(r.topic_id, r.event_id)
               for r in MT.match_posts(posts, tdf, strategy=strategy).collect()}
        assert got == want, strategy


def test_salted_shuffle_path_agrees(spark, monkeypatch):
    monkeypatch.setattr(MT, "BROADCAST_MAX_BYTES", 0)
    posts = spark.createDataFrame([("p1", "Alpha beta", "a"), ("p2", "gamma", "a")],
                                  "event_id string, text string, subreddit string") \
        .withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    tdf = spark.createDataFrame([("t", '[["alpha","gamma"]]', "")], TOPIC_DDL)
    got = {r.event_id for r in MT.match_inverted(posts, tdf).collect()}
    assert got == {"p1", "p2"}


def test_fixture_counts(spark):
    posts = fx.posts(spark, SF001)
    got = {r.topic_id: r["count"] for r in
           MT.match_posts(posts, fx.topics(spark, ""), strategy="narrow")
             .groupBy("topic_id").count().collect()}
    assert got == {"cnf-two": 1790, "phrase": 970, "flat": 1490}
    src = ",".join(f"src{i}" for i in range(10))
    got = {r.topic_id: r["count"] for r in
           MT.match_posts(posts, fx.topics(spark, src), strategy="inverted")
             .groupBy("topic_id").count().collect()}
    assert got == {"cnf-two": 940, "phrase": 470, "flat": 680}


def test_cutoff_is_inclusive(spark):
    as_of = fx.AS_OF
    cut = cutoff(as_of, "sync")
    rows = [("before", cut - dt.timedelta(seconds=1)), ("equal", cut), ("after", cut + dt.timedelta(seconds=1))]
    posts = spark.createDataFrame(rows, "event_id string, created_at timestamp") \
        .withColumn("text", F.lit("alpha")).withColumn("subreddit", F.lit("a"))
    tdf = spark.createDataFrame([("t", '["alpha"]', "")], TOPIC_DDL)
    for strategy in ("narrow", "inverted"):
        got = sorted(r.event_id for r in
                     MT.match_posts(posts, tdf, cutoff=cut, strategy=strategy).collect())
        assert got == ["after", "equal"]


def test_limit_per_topic_pages(spark):
    rows = [(f"e{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(250)]
    m = spark.createDataFrame(rows, "event_id string, created_at timestamp") \
        .withColumn("topic_id", F.lit("t"))
    out = MT.limit_per_topic(m, 120).collect()
    assert len(out) == 200  # cap rounded up to whole pages of 100
    assert min(r.event_id for r in out) == "e050"


def test_terms_without_letters_are_not_dropped(spark):
    texts = [("p1", "wow !!! great", "a"), ("p2", "a + b", "a"), ("p3", "plain", "a"),
             ("p4", "?? and !!!", "a")]
    posts = spark.createDataFrame(texts, "event_id string, text string, subreddit string") \
        .withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    topics = [("bang", '[["!!!"]]', ""), ("plus", '[["+"],["a","zzz"]]', ""),
              ("q", '[["??","!!!"],["and"]]', "")]
    tdf = spark.createDataFrame(topics, TOPIC_DDL)
    got = {(r.topic_id, r.event_id) for r in MT.match_inverted(posts, tdf).collect()}
    assert got == _brute(texts, topics) == {("bang", "p1"), ("bang", "p4"), ("plus", "p2"),
                                            ("q", "p4")}


def test_salted_path_with_phrases_agrees_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(MT, "BROADCAST_MAX_BYTES", 0)
    rnd = random.Random(11)
    vocab = ["alpha", "beta", "of", "the", "big data", "of the", "c++", "x-ray"]
    texts = [(f"p{i}", " ".join(rnd.choice(vocab + ["q", "r"]) for _ in range(rnd.randint(0, 10))),
              rnd.choice(["a", "b"])) for i in range(200)]
    topics = [(f"t{j}", str([[rnd.choice(vocab) for _ in range(rnd.randint(1, 2))]
                             for _ in range(rnd.randint(1, 2))]).replace("'", '"'),
               rnd.choice(["", "a"])) for j in range(15)]
    posts = spark.createDataFrame(texts, "event_id string, text string, subreddit string") \
        .withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    tdf = spark.createDataFrame(topics, TOPIC_DDL)
    got = {(r.topic_id, r.event_id) for r in MT.match_inverted(posts, tdf).collect()}
    assert got == _brute(texts, topics)


def test_auto_takes_any_catalogue(spark):
    groups = [[f"w{j}x{k}" for k in range(30)] for j in range(200)]
    topics = [(f"t{j}", str([g]).replace("'", '"'), "") for j, g in enumerate(groups)]
    posts = spark.createDataFrame([("p1", "see w3x29 and w199x0", "a"), ("p2", "w3x2", "a")],
                                  "event_id string, text string, subreddit string") \
        .withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    got = {(r.topic_id, r.event_id)
           for r in MT.match_posts(posts, spark.createDataFrame(topics, TOPIC_DDL)).collect()}
    assert got == {("t3", "p1"), ("t199", "p1"), ("t3", "p2")}


def test_letters_of_any_script(spark):
    texts = [("p1", "Ein Café in Köln", "a"), ("p2", "caf in kln", "a"), ("p3", "Добрый день", "a"),
             ("p4", "добрыйx", "a"), ("p5", "\U0001f600!", "a")]
    topics = [("cafe", '[["café"]]', ""), ("caf", '[["caf"]]', ""), ("ru", '[["добрый"]]', ""),
              ("smile", '[["\U0001f600"]]', ""), ("phrase", '[["café in"]]', "")]
    posts = spark.createDataFrame(texts, "event_id string, text string, subreddit string") \
        .withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    tdf = spark.createDataFrame(topics, TOPIC_DDL)
    want = {("cafe", "p1"), ("phrase", "p1"), ("caf", "p2"), ("ru", "p3"), ("smile", "p5")}
    assert _brute(texts, topics) == want
    for strategy in ("narrow", "inverted"):
        got = {(r.topic_id, r.event_id)
               for r in MT.match_posts(posts, tdf, strategy=strategy).collect()}
        assert got == want, strategy


def _rows(df):
    return sorted((r.topic_id, str(r.event_id), str(r.text), r.subreddit) for r in df.collect())


def _brute_rows(texts, topics):
    """One row per post row and matching topic, whatever the posts' ids."""
    out = []
    for i, (eid, text, sub) in enumerate(texts):
        out += [(tid, str(eid), str(text), sub) for tid, _ in _brute([(i, text, sub)], topics)]
    return sorted(out)


def test_repeated_and_missing_ids_agree_in_every_plan(spark, monkeypatch):
    rnd = random.Random(21)
    vocab = ["foo", "bar", "of", "the", "of the", "big data", "c++", "!!", "добрый", "x-ray"]
    texts = [("e1", "foo only", "a"), ("e1", "bar only", "a"), (None, "foo bar", "a"), ("e2", "foo bar", "a"),
             ("e2", "foo bar", "a"), (None, None, "a"), ("e3", "", "b")]
    texts += [(rnd.choice(["e1", "e2", None, f"p{i}"]),
               " ".join(rnd.choice(vocab + ["q", "r"]) for _ in range(rnd.randint(0, 9))),
               rnd.choice(["a", "B"])) for i in range(150)]
    topics = [("and", '[["foo"],["bar"]]', "")]
    topics += [(f"t{j}", str([[rnd.choice(vocab) for _ in range(rnd.randint(1, 2))]
                              for _ in range(rnd.randint(1, 3))]).replace("'", '"'),
                rnd.choice(["", "a"])) for j in range(20)]
    posts = spark.createDataFrame(texts, "event_id string, text string, subreddit string") \
        .withColumn("created_at", F.lit(dt.datetime(2024, 1, 1))).repartition(4)
    tdf = spark.createDataFrame(topics, TOPIC_DDL)
    want = _brute_rows(texts, topics)
    assert ("and", "None", "foo bar", "a") in want and len(want) > 150
    assert _rows(MT.match_posts(posts, tdf, strategy="narrow")) == want
    assert _rows(MT.match_posts(posts, tdf, strategy="inverted")) == want
    monkeypatch.setattr(MT, "BROADCAST_MAX_BYTES", 0)
    assert _rows(MT.match_posts(posts, tdf, strategy="inverted")) == want
    monkeypatch.setattr(MT, "KEY_BUCKETS", 1)     # every token passes the table
    assert _rows(MT.match_posts(posts, tdf, strategy="inverted")) == want


def test_a_phrase_is_keyed_by_its_rarest_run(spark):
    posts = spark.createDataFrame([(f"p{i}", "of the whole", "a") for i in range(9)]
                                  + [("q", "ox of the", "a")], "event_id string, text string, subreddit string")
    tdf = spark.createDataFrame([("t", '[["of the ox"],["whole thing","the"]]', "")], TOPIC_DDL)
    freq = MT.token_frequencies(posts, tdf)
    assert {r.tok: r.posts for r in freq.collect()} == {"of": 10, "the": 10, "ox": 1, "whole": 9}
    keys = {r.term: r.key for r in MT.term_table(tdf, freq).collect()}
    assert keys == {"of the ox": "ox", "whole thing": "thing", "the": "the"}
    assert MT.token_frequencies(posts, spark.createDataFrame([("t", '["one"]', "")], TOPIC_DDL)) is None


def test_inverted_plan_reads_the_posts_once(spark):
    topics = fx.topics(spark, "")
    plan = _plan(MT.match_posts(fx.posts(spark, SF001), topics, strategy="inverted"))
    assert len(re.findall(r"ReadSchema: struct<[^>]*\btext:string", plan)) == 1
    assert _count(plan, "CartesianProduct") == _count(plan, "BroadcastNestedLoopJoin") == 0
