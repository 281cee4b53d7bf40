"""Small column helpers: clamp, JS rounding, sentiment label, progress."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentiment label thresholds.
POSITIVE_AT = 0.05
NEGATIVE_AT = -0.05


def clamp(c: Column, lo, hi) -> Column:
    """clamp(v, lo, hi)."""
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def js_round(c: Column) -> Column:
    """``Math.round``: halves go up (towards +inf)."""
    return F.floor(c + F.lit(0.5))


def sentiment_label(c: Column) -> Column:
    """C11: >= 0.05 Positive, <= -0.05 Negative, else Neutral."""
    return (F.when(c >= F.lit(POSITIVE_AT), F.lit("Positive"))
             .when(c <= F.lit(NEGATIVE_AT), F.lit("Negative"))
             .otherwise(F.lit("Neutral")))


def backfill_progress(oldest_seen: Column, as_of: _dt.datetime,
                      cutoff_ts: _dt.datetime) -> Column:
    """clamp((now - oldest) / (now - cutoff) * 100, 0, 100), JS-rounded."""
    now_s = F.lit(int(as_of.replace(tzinfo=_dt.timezone.utc).timestamp()))
    cut_s = int(cutoff_ts.replace(tzinfo=_dt.timezone.utc).timestamp())
    total = now_s - F.lit(cut_s)
    elapsed = now_s - F.unix_micros(oldest_seen) / F.lit(1e6)
    return js_round(clamp(elapsed / total * F.lit(100.0), 0, 100)).cast("int")
