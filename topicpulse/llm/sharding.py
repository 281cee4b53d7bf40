"""K-d tree partitioning into shards of near equal bytes (operator 9), native.

The documents' metadata (never their text) is written once as a narrow table.
From the root, every node is split at the weighted median of its widest
dimension, all nodes of a level together, until a leaf holds one shard's share.
A weighted median is found by narrowing a range: one aggregate gives the bytes
of 1,024 equal ranges of each node, the range in which the target falls is
refined next.  Ties of the dimension are ordered by text hash, then by row, so
copies of a text stay together unless a cut must pass through them, and a
single value that holds a third of all bytes is split like any other.

Only sums of at most nodes x 1,024 ranges reach the driver.  The tree itself
has one node per shard and becomes a CASE expression, so rows are placed
without a join or a shuffle.  Slots are numbered per (shard, bucket) and
shifted by the buckets' running counts.

Edge cases: a null text has size 1; nulls, NaN and infinities in a dimension
count as 0; equal values are told apart by text, then by row; repeated rows get
slots of their own; a very long text is one row of its size, and its shard may
be larger than the others by no more than that; an empty table gives an empty
result; shards may stay empty when there are fewer rows than shards; all columns
but the text travel inside the struct ``row``, so no name of theirs can clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicpulse.llm.common import materialize

#: A cut may miss its target by this share of the node's bytes.
TOLERANCE = 0.0005
RANGES = 1024
ROWS_PER_BUCKET = 100_000


@dataclass
class Cut:
    """Rows of ``node`` whose key tuple is below ``at`` go to the left child."""

    node: int
    at: list[tuple[Column, float]]   # equal in all but the last, below in the last

    def left(self) -> Column:
        below = F.lit(False)
        equal = F.lit(True)
        for key, value in self.at:
            below = below | (equal & (key < F.lit(value)))
            equal = equal & (key == F.lit(value))
        return below


@dataclass
class Node:
    """A subtree that is to hold ``shards`` shards, from number ``first`` on."""

    first: int
    shards: int


def place(tree: list[tuple[Node, Cut, int]]) -> Column:
    """The first shard of the node in which a row lies, from the cuts made so far."""
    at = F.lit(0)
    for node, cut, right in tree:
        at = F.when((at == node.first) & ~cut.left(), F.lit(right)).otherwise(at)
    return at


def finite(c: Column) -> Column:
    """A dimension as a double, 0 where it is null, NaN or infinite."""
    c = c.cast("double")
    return F.when(F.abs(c) < F.lit(math.inf), c).otherwise(F.lit(0.0))


def find_cuts(rows: DataFrame, keys: dict[int, list[Column]], total: dict[int, int],
              share: dict[int, float]) -> dict[int, Cut]:
    """For each node the cut of its key tuple at ``share`` of its bytes.

    ``rows`` has the columns ``node`` and ``size``.
    """
    cuts: dict[int, Cut] = {}
    # per node: fixed leading keys with their values, bytes before the open range, its bounds
    state = {n: {"fixed": [], "before": 0, "range": None} for n in keys if total[n]}
    while len(cuts) < len(state):
        key = F.lit(None).cast("double")
        inside = F.lit(False)
        for n, s in state.items():
            if n in cuts:
                continue
            k = keys[n][len(s["fixed"])]
            mine = F.col("node") == n
            for fixed, value in s["fixed"]:
                mine = mine & (fixed == F.lit(value))
            if s["range"]:
                mine = mine & k.between(F.lit(s["range"][0]), F.lit(s["range"][1]))
            key = F.when(F.col("node") == n, k).otherwise(key)
            inside = inside | mine
        open_rows = rows.filter(inside).select("node", "size", key.alias("key"))
        for n, lo, hi in ((r[0], r[1], r[2]) for r in open_rows.groupBy("node").agg(
                F.min("key"), F.max("key")).collect()):
            state[n]["range"] = (lo, hi)
        bucket = F.lit(0)
        for n, s in state.items():
            if n not in cuts and s["range"][1] > s["range"][0]:
                lo, hi = s["range"]
                width = (hi - lo) / RANGES
                bucket = F.when(F.col("node") == n, F.least(
                    F.floor((F.col("key") - lo) / width), F.lit(RANGES - 1))).otherwise(bucket)
        got: dict[int, list] = {}
        for r in open_rows.groupBy("node", bucket.alias("bucket")).agg(
                F.sum("size").alias("size"), F.min("key").alias("lo"),
                F.max("key").alias("hi")).collect():
            got.setdefault(r["node"], []).append((r["lo"], r["hi"], r["size"]))
        for n, ranges in got.items():
            s = state[n]
            target = share[n] * total[n]
            before = s["before"]
            for lo, hi, size in sorted(ranges):
                if before + size >= target:
                    break
                before += size
            allowed = TOLERANCE * total[n]
            k = keys[n][len(s["fixed"])]
            after = min((r[0] for r in ranges if r[0] > hi), default=None)
            last = len(s["fixed"]) + 1 == len(keys[n])
            if lo == hi and last:
                # a single row is left: it goes to the side that it fits better
                past = before + size - target < target - before
                cuts[n] = Cut(n, [*s["fixed"], (k, math.nextafter(lo, math.inf) if past else lo)])
            elif target - before <= allowed:
                cuts[n] = Cut(n, [*s["fixed"], (k, lo)])
            elif before + size - target <= allowed and after is not None:
                cuts[n] = Cut(n, [*s["fixed"], (k, after)])
            elif lo == hi:
                s.update(fixed=[*s["fixed"], (k, lo)], before=before, range=None)
            else:
                s.update(before=before, range=(lo, hi))
    return cuts


def split_tree(rows: DataFrame, dims: list[str], shards: int) -> Column:
    """The shard expression of a k-d tree over ``rows`` (size, text_key, row_key, dims)."""
    tree: list[tuple[Node, Cut, int]] = []
    nodes = [Node(0, shards)]
    scale = rows.agg(*[F.max(d) - F.min(d) for d in dims]).first()
    while any(n.shards > 1 for n in nodes):
        placed = rows.withColumn("node", place(tree))
        stats = {r["node"]: r for r in placed.groupBy("node").agg(
            F.sum("size").alias("size"),
            *[F.sum(F.col("size") * F.col(d)).alias(f"s1_{d}") for d in dims],
            *[F.sum(F.col("size") * F.col(d) * F.col(d)).alias(f"s2_{d}") for d in dims]
        ).collect()}
        keys, total, share = {}, {}, {}
        for n in nodes:
            r = stats.get(n.first)
            if n.shards < 2 or r is None:
                continue
            spread = [(max(0.0, r[f"s2_{d}"] / r["size"] - (r[f"s1_{d}"] / r["size"]) ** 2)
                       / (scale[i] or 1.0) ** 2, -i) for i, d in enumerate(dims)]
            widest = dims[-max(spread)[1]]
            keys[n.first] = [F.col(widest), F.col("text_key"), F.col("row_key")]
            total[n.first] = r["size"]
            share[n.first] = (n.shards // 2) / n.shards
        cuts = find_cuts(placed, keys, total, share)
        below = []
        for n in nodes:
            half = n.shards // 2
            if n.first in cuts:
                tree.append((n, cuts[n.first], n.first + half))
                below += [Node(n.first, half), Node(n.first + half, n.shards - half)]
            else:
                below.append(Node(n.first, 1))
        nodes = below
    return place(tree)


def shard_documents(docs: DataFrame, shards: int, dims: dict[str, Column],
                    text: str = "text") -> DataFrame:
    """row (the columns of ``docs`` but the text), size, text_crc32, law, shard, slot,
    grown_shard.

    ``dims`` names the metadata dimensions and gives each as a numeric column
    expression over ``docs``.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = {f"dim_{d}": c for d, c in dims.items()}
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != text]).alias("row"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        # 52 bits, so that the keys are exact as doubles
        F.shiftrightunsigned(F.xxhash64(raw), 12).cast("double").alias("text_key"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 12).cast("double")
        .alias("row_key"),
        *[finite(c).alias(d) for d, c in named.items()])
    rows = materialize(rows, "shard-meta")
    n = rows.count()
    if n == 0:
        return rows.select("row", "size", "text_crc32", F.lit("bytes").alias("law"),
                           F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
    placed = rows.withColumn("shard", split_tree(rows, list(named), shards))
    buckets = max(8, -(-n // (shards * ROWS_PER_BUCKET)))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("row_key"), F.lit(buckets)))
    # one row per (shard, bucket): a running count over at most n / ROWS_PER_BUCKET rows
    counts = placed.groupBy("shard", "_bucket").count().withColumn(
        "_before", F.sum("count").over(W.partitionBy("shard").orderBy("_bucket")) - F.col("count")
    ).drop("count")
    numbered = placed.withColumn("_nth", F.row_number().over(
        W.partitionBy("shard", "_bucket").orderBy("row_key")) - 1)
    return numbered.join(counts, ["shard", "_bucket"]).select(
        "row", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
