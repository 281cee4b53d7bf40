"""Batch reader for the raw post feed (JSON or parquet files).

The remote feed is paged (100 posts per page, newest first); stored as
files, paging becomes file splits and the reader needs no ordering.  The
declared schema avoids inference and keeps every field nullable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicpulse.schemas import RAW_POST_SCHEMA


def read_raw_posts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    if fmt == "json":
        # PERMISSIVE: a malformed record keeps its row with null fields.
        return spark.read.schema(RAW_POST_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return spark.read.format(fmt).schema(RAW_POST_SCHEMA).load(path)
