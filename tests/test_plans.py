"""Plan-shape regressions: the properties the design relies on at scale."""

import contextlib
import io
import re

import __spark_entry__ as E
from tests.conftest import SF0001

STREAMING = ("stream_", "backfill_", "pipeline_report", "raw_feed_json", "sync_resend", "report_from_log")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text.split("== Initial Plan ==")[-1]


def _count(plan: str, node: str) -> int:
    ids = set(re.findall(rf"^\((\d+)\) {node}\b", plan, flags=re.M))
    return len(ids)


def test_no_nested_loop_joins_and_no_python_on_the_data_path(spark):
    for name, fn in E.REGISTRY.items():
        if name.startswith(STREAMING):
            continue
        plan = _plan(fn(spark, SF0001))
        assert _count(plan, "BroadcastNestedLoopJoin") == 0, name
        assert _count(plan, "CartesianProduct") == 0, name
        python_nodes = sum(_count(plan, n) for n in ("ArrowEvalPython", "BatchEvalPython",
                                                     "MapInPandas", "FlatMapGroupsInPandas"))
        # Only the pluggable model hook (U2) runs Python, over Arrow batches.
        assert python_nodes == (1 if name == "sentiment_model" else 0), name


def test_report_and_timelines_scan_once(spark):
    q = E.queries()
    for name in ("report_all_topics", "timeline_1w_3m", "growth_clipped", "summary_this_month"):
        plan = _plan(q[name](spark, SF0001))
        assert _count(plan, "Scan parquet") == 1, name
        assert _count(plan, "Exchange") <= 2, name


def test_narrow_match_adds_no_shuffle(spark):
    q = E.queries()
    plan = _plan(q["match_cnf_narrow"](spark, SF0001))
    # Only the F1 feed's own exchanges: its layout repartition and the scalar
    # count(*) subquery; the matcher itself is a single pipelined stage.
    assert _count(plan, "Exchange") <= 2
    assert _count(plan, "SortMergeJoin") == 0
