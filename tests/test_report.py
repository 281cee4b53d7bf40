import datetime as dt

from pyspark.sql import functions as F

from topicpulse.operators import metrics as M
from topicpulse.sources import fixtures as fx
from tests.conftest import SF001

AS_OF = fx.AS_OF


def _rows(df):
    return {(r.window_type, r.start): r for r in df.collect()}


def test_golden_click_report(spark):
    r = _rows(M.report(fx.topic_posts(spark, SF001), AS_OF, topic_id="click"))
    assert len(r) == 863
    assert sum(1 for k in r if k[0] == "1d") == 732
    assert sum(1 for k in r if k[0] == "1w") == 105
    assert sum(1 for k in r if k[0] == "1m") == 26
    jan = r[("1m", dt.datetime(2024, 1, 1))]
    assert (jan.mentions, jan.engagement, jan.growth) == (2006, 202072, 1.0)
    assert round(jan.sentiment, 6) == 0.027418
    feb = r[("1m", dt.datetime(2024, 2, 1))]
    assert (feb.mentions, feb.engagement, feb.sentiment, feb.growth) == (0, 0, 0.0, 0.0)
    assert feb.end == dt.datetime(2024, 3, 2)  # flat 30 days
    weeks = [(dt.datetime(2023, 12, 25), 0, 0, 1.0), (dt.datetime(2024, 1, 1), 493, 47934, 1.0),
             (dt.datetime(2024, 1, 8), 432, 43633, 0.876268),
             (dt.datetime(2024, 1, 15), 481, 49547, 1.113426),
             (dt.datetime(2024, 1, 22), 469, 46005, 0.975052),
             (dt.datetime(2024, 1, 29), 131, 14953, 0.279318)]
    for start, m, e, g in weeks:
        w = r[("1w", start)]
        assert (w.mentions, w.engagement, round(w.growth, 6)) == (m, e, g)


def _edge(spark):
    rows = [
        ("a", dt.datetime(2024, 1, 2, 5), 10, None),      # null sentiment stays in denominator
        ("a", dt.datetime(2024, 1, 2, 6), 5, 0.5),
        ("a", dt.datetime(2021, 6, 1), 1, 1.0),           # before now-2y: extends the spine
        ("a", dt.datetime(2024, 3, 5), 2, 0.0),           # after now+1d: extends the spine
        ("b", dt.datetime(2024, 1, 10), None, None),      # missing engagement -> 0
    ]
    return spark.createDataFrame(
        rows, "topic_id string, created_at timestamp, engagement int, sentiment_score float")


def test_null_sentiment_denominator_and_bounds(spark):
    df = _edge(spark)
    r = _rows(M.report(df.where("topic_id = 'a'"), AS_OF))
    d = r[("1d", dt.datetime(2024, 1, 2))]
    assert d.mentions == 2 and d.engagement == 15 and d.sentiment == 0.25
    days = sorted(k[1] for k in r if k[0] == "1d")
    assert days[0] == dt.datetime(2021, 6, 1) and days[-1] == dt.datetime(2024, 3, 5)
    months = sorted(k[1] for k in r if k[0] == "1m")
    assert months[0] == dt.datetime(2021, 6, 1) and months[-1] == dt.datetime(2024, 3, 1)


def test_topic_without_posts_gets_zero_series(spark):
    df = _edge(spark)
    topics = spark.createDataFrame([("a",), ("zzz",)], "topic_id string")
    r = M.report(df, AS_OF, topics=topics).where("topic_id = 'zzz'")
    rows = r.collect()
    assert len(rows) == 863
    assert all(x.mentions == 0 and x.engagement == 0 for x in rows)
    assert {x.growth for x in rows} == {1.0}
    b = M.report(df, AS_OF).where("topic_id = 'b' AND start = '2024-01-10'").collect()
    assert [(x.window_type, x.engagement) for x in b] == [("1d", 0)]


def test_growth_zero_nonzero_zero(spark):
    rows = [("g", dt.datetime(2024, 1, 3)), ("g", dt.datetime(2024, 1, 3, 1))]
    df = spark.createDataFrame(rows, "topic_id string, created_at timestamp") \
        .withColumn("engagement", F.lit(1)).withColumn("sentiment_score", F.lit(0.0))
    r = _rows(M.report(df, AS_OF))
    assert r[("1d", dt.datetime(2024, 1, 2))].growth == 1.0   # 0 after 0
    assert r[("1d", dt.datetime(2024, 1, 3))].growth == 1.0   # previous 0 -> 1.0
    assert r[("1d", dt.datetime(2024, 1, 4))].growth == 0.0   # 0 after non-zero


def test_day_sums_equal_month_sums(spark):
    r = M.report(fx.topic_posts(spark, SF001), AS_OF)
    s = {x.window_type: x.m for x in r.groupBy("window_type").agg(F.sum("mentions").alias("m")).collect()}
    assert s["1d"] == s["1w"] == s["1m"] == 10000


def test_single_scan_plan(spark):
    r = M.report(fx.topic_posts(spark, SF001), AS_OF)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 or plan.count("Scan parquet") == 1
