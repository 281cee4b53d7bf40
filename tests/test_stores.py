"""Stored posts and topics, the incremental report, the cap by threshold, rejects."""

import datetime as dt
import os
import random
import re
import tempfile

from pyspark.sql import functions as F
from tests.conftest import SF001
from tests.test_plans import _plan

from topicpulse.operators import matching as MT
from topicpulse.operators import metrics as M
from topicpulse.operators import normalize as NO
from topicpulse.operators import topics as TO
from topicpulse.sources import fixtures as fx
from topicpulse.sources import poststore as PS
from topicpulse.streaming import backfill as BF
from topicpulse.streaming import sync as SY
from topicpulse.streaming import trends as TR
from topicpulse.streaming import upsert as UP

DAY = dt.datetime(2024, 1, 1)


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="topicpulse-test-"), "t")


def listed_days(df):
    """The day folders whose files the rows of a plan come from."""
    files = df.select(F.input_file_name().alias("f")).distinct().collect()
    return sorted(re.search("event_date=([0-9-]+)", r.f)[1] for r in files)


def test_look_back_lists_only_its_days(spark):
    path = folder()
    rows = [(f"e{i}", DAY + dt.timedelta(hours=7 * i), "alpha", "s") for i in range(60)] + [("none", None, "alpha", "s")]
    posts = spark.createDataFrame(rows, "event_id string, created_at timestamp, text string, subreddit string")
    PS.write_posts(posts, path)
    since = DAY + dt.timedelta(days=14, hours=5)
    got = PS.read_posts(spark, path, since=since, until=since + dt.timedelta(days=2))
    assert got.columns == posts.columns
    want = {r[0] for r in rows if r[1] and since <= r[1] <= since + dt.timedelta(days=2)}
    assert {r.event_id for r in got.collect()} == want
    assert listed_days(got) == ["2024-01-15", "2024-01-16", "2024-01-17"]
    assert PS.read_posts(spark, path).count() == len(rows)
    # the matcher's cutoff prunes the store by itself, in both plans
    topics = spark.createDataFrame([("t", '["alpha"]', "")], "id string, keywords string, subreddits string")
    for strategy in ("narrow", "inverted"):
        m = MT.match_posts(spark.read.parquet(path), topics, cutoff=since, strategy=strategy)
        assert PS.DATE_COL not in m.columns
        assert {r.event_id for r in m.collect()} == {r[0] for r in rows if r[1] and r[1] >= since}
        assert re.search(r"PartitionFilters: \[[^\]]*event_date[^\]]*>= 2024-01-15", _plan(m))


def test_registered_look_backs_are_pruned(spark):
    posts = fx.stored_posts(spark, SF001)
    for preset, first in (("sync", "2024-01-29"), ("backfill", "2024-01-01")):
        events = SY.matched_events(posts, fx.topics(spark, ""), fx.AS_OF, preset, "narrow")
        assert re.search(rf"PartitionFilters: \[[^\]]*event_date[^\]]*>= {first}", _plan(events))


def test_windows_known_at_run_time(spark):
    path = folder()
    rows = [(f"e{i}", DAY + dt.timedelta(hours=i)) for i in range(300)]
    PS.write_posts(spark.createDataFrame(rows, "event_id string, created_at timestamp"), path)
    h = [DAY + dt.timedelta(hours=x) for x in range(400)]
    spans = [(h[3], h[5]), (h[4], h[30]), (h[30], h[31]), (h[200], h[200]), (h[50], h[40]), (h[3], h[5])]
    windows = spark.createDataFrame(spans, "since timestamp, until timestamp").where("since IS NOT NULL")
    got = PS.read_windows(spark, path, windows)
    want = sorted(e for e, t in rows if any(a <= t <= b for a, b in spans))
    assert sorted(r.event_id for r in got.collect()) == want
    assert PS.read_windows(spark, path, windows.limit(0)).count() == 0


def brute_limit(rows, k):
    out = []
    for topic in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == topic]
        own.sort(key=lambda r: (r[2] is None, -(r[2].timestamp() if r[2] else 0), r[1] is not None, r[1] or ""))
        out += own[:k]
    return out


def test_cap_is_exact_with_ties_and_nulls(spark):
    rnd = random.Random(3)
    rows = []
    for topic, n in (("hot", 900), ("cold", 40), (None, 250), ("full", 200)):
        rows += [(topic, rnd.choice([None, *(f"e{j}" for j in range(60))]),
                  rnd.choice([None, *(DAY + dt.timedelta(minutes=rnd.choice([1, 2, 90, 91, 5000])) for _ in range(9))]),
                  "text") for _ in range(n)]
    df = spark.createDataFrame(rows, "topic_id string, event_id string, created_at timestamp, text string")
    got = [tuple(r) for r in MT.limit_per_topic(df.repartition(7), 150).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_limit(rows, 200)))


def test_cap_keeps_as_many_equal_rows_as_fit(spark):
    rows = [("t", "same", DAY, "x")] * 500
    df = spark.createDataFrame(rows, "topic_id string, event_id string, created_at timestamp, text string")
    assert MT.limit_per_topic(df, 100).count() == 100
    assert MT.limit_per_topic(df.limit(0), 100).count() == 0


def test_no_text_enters_a_window_of_the_cap(spark):
    df = spark.createDataFrame([("t", f"e{i}", DAY, "words") for i in range(300)],
                               "topic_id string, event_id string, created_at timestamp, text string")
    plan = _plan(MT.limit_per_topic(df, 100))
    for block in re.split(r"\n\n+", plan):
        if re.match(r"\(\d+\) (Window|WindowGroupLimit)\b", block):
            assert "text#" not in block, block


VERSION = "topic_id string, event_id string, created_at timestamp, engagement int, sentiment_score double"


def test_incremental_report_equals_a_full_one_after_every_batch(spark):
    path, rnd, now = folder(), random.Random(5), {}
    for n in range(4):
        batch = {}
        for _ in range(80):
            i = rnd.randint(0, 60)
            key = (rnd.choice("ab"), f"e{i}")
            batch[key] = (DAY + dt.timedelta(hours=5 * i), rnd.choice([None, rnd.randint(1, 9)]),
                          rnd.choice([None, rnd.randint(-4, 4) / 4]))
        rows = [(*k, *v) for k, v in batch.items()] + [(None, "x", DAY, 1, 1.0), ("a", "y", None, 1, 1.0)]
        df = spark.createDataFrame(rows, VERSION)
        for _ in range(1 + n % 2):                     # a replay changes nothing
            TR.apply_batch(df, n, path, as_of=fx.AS_OF)
        for k, (t, e, s) in batch.items():
            old = now.get(k, (t, None, None))
            now[k] = (t, old[1] if e is None else e, old[2] if s is None else s)
        full = M.report(spark.createDataFrame([(*k, *v) for k, v in now.items()], VERSION), fx.AS_OF)

        def rows_of(d):
            return sorted((r.topic_id, r.start, r.window_type, r.mentions, r.engagement, round(r.sentiment, 9),
                           round(r.growth, 9)) for r in d.collect())

        assert rows_of(TR.report_now(spark, path, fx.AS_OF)) == rows_of(full)
        assert rows_of(spark.read.parquet(os.path.join(path, "report", f"batch={n}"))) == rows_of(full)


def test_a_cycle_reads_the_state_of_its_days_only(spark):
    path = folder()
    rows = [("a", f"e{i}", DAY + dt.timedelta(days=i), 1, 0.5) for i in range(20)]
    TR.apply_batch(spark.createDataFrame(rows, VERSION), 0, path)
    days = [(DAY + dt.timedelta(days=d)).date() for d in (3, 4)]
    old = TR.old_versions(spark, path, days, 1)
    files = {re.search("day=([0-9-]+)", f)[1] for f in
             (r.f for r in old.select(F.input_file_name().alias("f")).collect())}
    assert files == {"2024-01-04", "2024-01-05"} and old.count() == 2
    assert TR.old_versions(spark, path, days, 0) is None


TOPIC = "id string, keywords string, subreddits string, description string, filters_json string, " \
        "update_frequency_seconds int, seq long"


def test_insert_is_idempotent_and_ids_stay_unique(spark):
    path = folder()

    def rows(*ids):
        return spark.createDataFrame([(i, '["k"]' if i != "bad" else "", "s", None, None, 0, n)
                                      for n, i in enumerate(ids)], TOPIC)

    first = {(r.seq, r.outcome) for r in TO.insert_topics(rows("a", "b", "a", "bad"), path, 0, DAY).collect()}
    assert first == {(0, "inserted"), (1, "inserted"), (2, "duplicate"), (3, "invalid")}
    for _ in range(2):
        second = TO.insert_topics(rows("b", "c", None, "c"), path, 1, DAY).collect()
        assert {(r.seq, r.outcome) for r in second} == {(0, "duplicate"), (1, "inserted"), (2, "invalid"),
                                                        (3, "duplicate")}
    stored = TO.stored_topics(spark, path)
    assert sorted((r.id, r.batch) for r in stored.collect()) == [("a", 0), ("b", 0), ("c", 1)]
    assert {r.update_frequency_seconds for r in stored.collect()} == {TO.DEFAULT_FREQUENCY_S}


def test_lookup_reaches_the_scan(spark):
    t = TO.read_topics(spark, "parquet", fx.topic_store(spark, SF001))
    one = TO.topic_by_id(t, "topic-40")
    assert "EqualTo(id,topic-40)" in _plan(one) and one.count() == 1


def test_rejects_keep_their_text_and_reason(spark):
    good = '{"topic_id":"t","event_id":"e","score":3,"text":"x"}'
    values = [good, '{"topic_id":"t","event_id":', "", None, "  ", '{"event_id":"e"}', '{"topic_id":"t"}', "[1]", "7"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    events, rejects = NO.parse_with_rejects(df)
    assert [(r.topic_id, r.event_id, r.score) for r in events.collect()] == [("t", "e", 3)]
    got = sorted(((r.value or "", r.reason) for r in rejects.collect()))
    reasons = dict(got)
    assert len(got) == len(values) - 1
    assert reasons['{"topic_id":"t","event_id":'] == "malformed" and reasons["  "] == reasons[""] == "empty"
    assert reasons['{"event_id":"e"}'] == "no topic_id" and reasons['{"topic_id":"t"}'] == "no event_id"
    assert "7" in reasons and "[1]" in reasons


def test_backfill_tells_its_progress_while_it_runs(spark):
    out = folder()
    tasks = spark.createDataFrame([('{"topic_id":"t"}',)], "value string")
    topics = spark.createDataFrame([("t", '["alpha"]', "", "")],
                                   "id string, keywords string, subreddits string, description string")
    rows = [(f"p{i}", "alpha", "a", fx.AS_OF - dt.timedelta(days=i), 1, 0) for i in range(-1, 40)]
    posts = spark.createDataFrame(rows, "event_id string, text string, subreddit string, "
                                        "created_at timestamp, score int, num_comments int")
    path = folder()
    PS.write_posts(posts, path)
    for source in (posts, spark.read.parquet(path)):
        for _ in range(2):                                   # the second run is a replay
            BF.run_backfill_batch(tasks, 3, topics, source, fx.AS_OF, out, n_slices=5)
        events = BF.read_status(spark, out).orderBy("seq").collect()
        assert [(e.status, e.percentage) for e in events] == [
            ("PENDING", None), *[(None, p) for p in (20.0, 40.0, 60.0, 80.0, 100.0)], ("COMPLETED", 100.0)]
        assert [e.slice_rows for e in events] == [0, 8, 6, 6, 6, 6, 0]       # days -1 to 6, then six a slice
        log = UP.read_log(spark, os.path.join(out, "events"))
        assert sorted(r.event_id for r in log.collect()) == sorted(f"p{i}" for i in range(-1, 31))
    spans = BF.slices(fx.AS_OF, 4)
    assert spans[0][1] is None and all(a[0] == b[1] for a, b in zip(spans, spans[1:]))
