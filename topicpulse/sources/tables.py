"""Readers for the input tables (one parquet dataset per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` as a UTC ``timestamp`` (stored as timestamp_ntz)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))
