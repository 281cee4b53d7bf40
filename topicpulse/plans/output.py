"""Presentation of registered query results.

Timestamps leave as ISO-8601 UTC text (the wire format of the report) and
doubles are rounded to 6 decimals, because bucket sums add floats in a
different order than a single-pass engine would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicpulse.functions.calendar import iso_utc


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_utc(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)
