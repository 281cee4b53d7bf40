"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from topicpulse.session import scratch_dir


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """A value made once per Python worker and kept across its tasks.

    Functions of this subpackage travel by value, so their module globals are
    new in every task; the value hangs on ``sys``, which lives as long as the
    worker does.  Only the value asked for last is kept: a worker that goes on
    to another operator or model gives the old one's memory back.
    """
    held = sys.__dict__.setdefault("_topicpulse_llm", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with files that every executor can read, so a lost
    executor costs no recomputation of what is written.  ``narrow`` is for
    tables of a few numbers per row: they go to a sixth of the shuffle
    partitions, so that small tables do not become many tiny files.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    out = df.coalesce(max(1, -(-shuffle_width(spark) // 6))) if narrow else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores appended until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
