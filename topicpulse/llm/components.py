"""Connected components of a link table by shuffles alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse.llm.common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """node, label for every end of an edge (a, b); label is the component's least node.

    Every round lets each node point to its least neighbour (or itself), follows
    the pointers by doubling until they reach local minima, and contracts the
    edges: their ends are replaced by what they point to, loops and repeats go.
    Each round at least halves the nodes that still have edges, so the edges
    shrink and rounds and doublings grow with the logarithm of the input.  A hot
    node's edges meet in a partial minimum before they are shuffled; joins on a
    hot node are left to the skew join.
    """
    first = _written(edges.filter("a IS NOT NULL AND b IS NOT NULL"), F.col("a"), F.col("b"))
    labels = first.select("u").union(first.select("v")).distinct().select(
        F.col("u").alias("node"), F.col("u").alias("label"))
    left = first.filter("u < v")
    while left.limit(1).count():
        both = left.union(left.select("v", "u"))
        points = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("to"))
        moved = True
        while moved:
            further = points.select(F.col("u").alias("mid"), F.col("to").alias("end"))
            points = materialize(points.join(further, F.col("to") == F.col("mid")).select(
                "u", F.col("end").alias("to"), (F.col("end") < F.col("to")).alias("moved")),
                "pointers", narrow=True)
            moved = points.filter("moved").limit(1).count()
        labels = labels.join(points, F.col("label") == F.col("u"), "left").select(
            "node", F.coalesce("to", "label").alias("label"))
        to_v = points.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        left = _written(left.join(points, "u").join(to_v, "v"), F.col("to"), F.col("to_v")).filter(
            "u < v")
    return materialize(labels, "labels", narrow=True)


def _written(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """The distinct pairs (u <= v) of two columns, written out."""
    return materialize(rows.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
                       .distinct(), "edges", narrow=True)
