import datetime as dt

from pyspark.sql import functions as F

from topicpulse.functions.calendar import range_bounds, resolve_range, valid_ranges
from topicpulse.operators import dashboard as D
from topicpulse.operators import metrics as M
from topicpulse.operators import timeline as TL
from topicpulse.sources import fixtures as fx
from tests.conftest import SF001

AS_OF = fx.AS_OF


def _ms(d):
    return int(d.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_range_bounds_and_valid_ranges():
    assert range_bounds("this_week", AS_OF) == (dt.datetime(2024, 1, 29), dt.datetime(2024, 2, 5))
    assert range_bounds("this_month", AS_OF) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))
    assert range_bounds("3m", AS_OF)[0] == dt.datetime(2023, 11, 1)
    assert range_bounds("12m", AS_OF)[0] == dt.datetime(2023, 2, 1)
    assert valid_ranges("1w") == ("this_month", "3m", "6m")
    assert resolve_range("1m", "this_week") == "12m"
    assert resolve_range("1d", "3m") == "3m"


def test_golden_weekly_timeline(spark):
    r = M.report(fx.topic_posts(spark, SF001), AS_OF, topic_id="click")
    bars = TL.timeline(r, "1w", "3m", AS_OF).orderBy("end").collect()
    assert len(bars) == 14
    assert bars[0].end == _ms(dt.datetime(2023, 11, 1))
    by = {b.end: b for b in bars}
    assert by[_ms(dt.datetime(2023, 12, 27))].mentions == 493   # holds week 2024-01-01
    last = bars[-1]
    assert last.end == _ms(dt.datetime(2024, 1, 31))
    assert last.mentions == 0 and last.growth == 0.0            # empty bar: growth 0


def test_summary_cards(spark):
    r = M.report(fx.topic_posts(spark, SF001), AS_OF, topic_id="click")
    w = TL.summary(r, "this_week", AS_OF).first()
    assert (w.mentions, w.engagement) == (131, 14953)
    m = TL.summary(r, "this_month", AS_OF).first()
    assert (m.mentions, m.engagement, round(m.sentiment, 6), m.label) == (
        2006, 202072, 0.027418, "Neutral")


def test_growth_clipped_to_now(spark):
    r = M.report(fx.topic_posts(spark, SF001), AS_OF, topic_id="click")
    bars = TL.timeline(r, "1d", "this_month", AS_OF, clip_to_now=True).collect()
    assert max(b.end for b in bars) == _ms(dt.datetime(2024, 1, 31))
    assert len(bars) == 31


def _dash(spark):
    rows = [("a", dt.datetime(2024, 1, 30, 10), 5, 0.5),
            ("a", dt.datetime(2024, 1, 30, 11), None, 0.1),      # null engagement: excluded
            ("b", dt.datetime(2024, 1, 29, 10), 3, None),        # null sentiment: excluded
            ("b", dt.datetime(2024, 1, 28, 10), 7, -0.1),
            ("a", dt.datetime(2023, 12, 1), 9, 0.9)]             # outside the month
    return spark.createDataFrame(rows, "topic_id string, created_at timestamp, "
                                       "engagement int, sentiment_score double")


def test_kpis_and_empty_range(spark):
    k = D.kpis(_dash(spark), AS_OF).first()
    assert (k.matched_posts, k.engagement) == (2, 12)
    assert abs(k.avg_sentiment - 0.2) < 1e-9
    e = D.kpis(_dash(spark), AS_OF, topics=["nobody"]).first()
    assert (e.matched_posts, e.avg_sentiment, e.engagement) == (None, None, None)


def test_daily_panels_empty_days(spark):
    df = _dash(spark)
    cnt = {r.day: r.value for r in D.daily_panel(df, AS_OF, "count").collect()}
    eng = {r.day: r.value for r in D.daily_panel(df, AS_OF, "engagement").collect()}
    sen = {r.day: r.value for r in D.daily_panel(df, AS_OF, "sentiment").collect()}
    assert len(cnt) == 32
    empty = dt.datetime(2024, 1, 15)
    assert cnt[empty] == 0 and eng[empty] is None and sen[empty] is None
    assert cnt[dt.datetime(2024, 1, 30)] == 1 and eng[dt.datetime(2024, 1, 30)] == 5


def test_report_vs_dashboard_sentiment_differ(spark):
    df = _dash(spark).withColumn("engagement", F.coalesce("engagement", F.lit(0)))
    r = {(x.window_type, x.start): x for x in M.report(df.where("topic_id = 'b'"), AS_OF).collect()}
    # report: null sentiment stays in the denominator
    assert r[("1d", dt.datetime(2024, 1, 29))].sentiment == 0.0
