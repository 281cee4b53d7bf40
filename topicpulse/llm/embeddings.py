"""Near duplicates among embeddings by an epsilon grid order join (operator 2).

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t) of each other.
Equal vectors are first merged into classes.  The classes are projected on a
few leading principal axes (fitted on a bounded sample; any orthonormal axes
give the same result), sorted by their grid cells of side eps along these axes,
and the sequence is cut into intervals.  Every interval has a box over the
projections and the length of what they leave out, which bounds distances from
below.  Pairs of intervals are joined recursively from the whole sequence
down: first as rows, by a fan-out of 16 per level down to groups of
neighbouring leaf intervals, then inside a task, leaf by leaf and by halves; a
pair whose boxes are more than eps apart is skipped with all
below it.  What is left is compared in double precision.

A pair of groups is one unit of work, so each leaf is sent once for each group
within reach of its own, not once for each leaf.  Groups hold a twelfth of the
sequence, up to GROUP_BYTES: below that size what is shuffled grows with the
input, above it with the pairs of groups within reach.  A task holds one group
and streams the other.  A pair of leaves returns, per vector, how many links it
found and one edge to its local component, so a dense group of g vectors costs
g rows, not g squared.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link; a
repeated row is a vector of its own; a null vec_id takes part but names no
component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicpulse.llm.common import materialize, shuffle_width
from topicpulse.llm.components import connected

AXES = 8
#: Vectors that the axes are fitted on, at most.
SAMPLE = 2048
#: Vectors of a leaf interval, and of the smallest piece that a task splits it to.
LEAF = 2048
PIECE = 128
LEAVES_PER_TASK = 2
#: Groups of leaves that the sequence is cut into, unless a group is larger than
#: GROUP_BYTES; neither changes the result.
GROUPS = 12
GROUP_BYTES = 64 << 20
#: Children per level of the distributed recursion, as a power of two.
FAN_BITS = 4
_LEAF_BITS = 20


def usable(v: Column) -> Column:
    """Whether a vector can link: finite, without nulls, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(
        F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow on the way."""
    rows = np.asarray(rows, dtype=np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes of the most frequent vector length, from a bounded sample."""
    got = classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for r in got:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    if not by_size:
        return {}
    size, rows = max(by_size.items(), key=lambda kv: (len(kv[1]), kv[0]))
    x = unit(np.array(rows, dtype=np.float64))
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    return {size: axes[:AXES].T}


def coordinates(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Projections on the axes and the length of the rest: (n, AXES + 1).

    Distances between these rows never exceed those between the vectors.
    """
    basis = axes.get(x.shape[1])
    if basis is None:
        basis = np.eye(x.shape[1])[:, :AXES]
    p = x @ basis
    rest = np.sqrt(np.maximum(0.0, (x * x).sum(1) - (p * p).sum(1)))
    out = np.zeros((len(x), AXES + 1))
    out[:, :p.shape[1]] = p
    out[:, AXES] = rest
    return out


def gap2(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """Squared distance of two boxes."""
    g = np.maximum(0.0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return float((g * g).sum())


def join_intervals(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray,
                   threshold: float, reach2: float, same: bool) -> list[tuple]:
    """(i, j) index arrays of all pairs with cosine >= threshold, found by
    splitting both intervals in halves and skipping boxes out of reach."""
    found = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        i0, i1, j0, j1 = waiting.pop()
        if same and j1 <= i0:
            continue
        pa, pb = ca[i0:i1], cb[j0:j1]
        if gap2(pa.min(0), pa.max(0), pb.min(0), pb.max(0)) > reach2:
            continue
        if max(i1 - i0, j1 - j0) <= PIECE:
            i, j = np.nonzero(a[i0:i1] @ b[j0:j1].T >= threshold)
            if same:
                keep = i + i0 < j + j0
                i, j = i[keep], j[keep]
            if len(i):
                found.append((i + i0, j + j0))
        elif i1 - i0 >= j1 - j0:
            mid = (i0 + i1) // 2
            waiting += [(i0, mid, j0, j1), (mid, i1, j0, j1)]
        else:
            mid = (j0 + j1) // 2
            waiting += [(i0, i1, j0, mid), (i0, i1, mid, j1)]
    return found


def summarize(found: list[tuple], nodes_a: np.ndarray, nodes_b: np.ndarray, copies_a: np.ndarray,
              copies_b: np.ndarray, same: bool) -> pd.DataFrame:
    """node, links, to: per linked vector its links (copies counted) and an edge to
    the least node of its component within this pair of intervals."""
    i = np.concatenate([f[0] for f in found])
    j = np.concatenate([f[1] for f in found])
    n = len(nodes_a)
    if not same:
        j = j + n
    nodes = nodes_a if same else np.concatenate([nodes_a, nodes_b])
    copies = copies_a if same else np.concatenate([copies_a, copies_b])
    links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
    label = nodes.copy()
    while True:
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if (old == label).all():
            break
    on = links > 0
    return pd.DataFrame({"node": nodes[on], "links": links[on].astype(np.int64), "to": label[on]})


def leaves_of(classes: DataFrame, axes: dict[int, np.ndarray], eps: float, n: int) -> DataFrame:
    """The intervals of the epsilon grid order: part, leaf, size, lo, hi, payloads."""
    double = "double" in dict(classes.dtypes)["v"]
    kind = np.float64 if double else np.float32
    element = "double" if double else "float"

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["v"].map(len).to_numpy()
            cell = np.empty(len(batch), dtype=object)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                x = unit(np.stack(batch["v"].to_numpy()[at]))
                grid = np.floor(coordinates(x, axes)[:, :AXES] / eps).astype(np.int32)
                for k, row in zip(at, grid):
                    cell[k] = row
            yield pd.DataFrame({"v": batch["v"], "rep": batch["rep"].astype("Int64"),
                                "copies": batch["copies"], "size": size.astype(np.int32),
                                "cell": cell})

    parts = max(1, -(-n // (LEAF * LEAVES_PER_TASK)))
    ordered = classes.mapInPandas(
        cells, f"v array<{element}>, rep long, copies long, size int, cell array<int>"
    ).repartitionByRange(parts, "size", "cell", F.xxhash64("v"))
    ordered = ordered.sortWithinPartitions("size", "cell", F.xxhash64("v")).withColumn(
        "part", F.spark_partition_id())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        seq = 0

        def leaf(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal seq
            v = np.stack(rows["v"].to_numpy()).astype(kind)
            c = coordinates(unit(v), axes)
            part = int(rows["part"].iloc[0])
            made = pd.DataFrame({
                "part": [part], "leaf": [(part << _LEAF_BITS) + seq], "size": [v.shape[1]],
                "lo": [c.min(0)], "hi": [c.max(0)], "vectors": [v.tobytes()],
                "reps": [rows["rep"].astype("Int64").to_numpy(np.int64, na_value=0).tobytes()],
                "named": [rows["rep"].notna().to_numpy().tobytes()],
                "copies": [rows["copies"].to_numpy(np.int64).tobytes()]})
            seq += 1
            return made

        def ready(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held
            if not held:
                return
            rows = pd.concat(held, ignore_index=True)
            held = []
            while len(rows):
                same = int((rows["size"] == rows["size"].iloc[0]).cumprod().sum())
                take = min(same, LEAF)
                if take == len(rows) and take < LEAF and not last:
                    held = [rows]
                    return
                yield leaf(rows.iloc[:take])
                rows = rows.iloc[take:].reset_index(drop=True)

        for batch in batches:
            held.append(batch)
            yield from ready(False)
        yield from ready(True)

    return ordered.mapInPandas(
        cut, "part int, leaf long, size int, lo array<double>, hi array<double>, vectors binary, "
             "reps binary, named binary, copies binary")


def near_groups(leaves: DataFrame, groups: int, eps: float) -> DataFrame:
    """Pairs of groups (a <= b) within reach, by recursion from the whole sequence."""
    reach2 = eps * eps * (1 + 1e-9)
    levels = 1
    while groups > 1 << (FAN_BITS * levels):
        levels += 1
    base = leaves.select(F.col("group").cast("long").alias("group"), "size", "lo", "hi")

    def boxes(index: Column, above: Column) -> DataFrame:
        k = AXES + 1
        return base.groupBy(index.alias("id"), above.alias("above"), "size").agg(
            F.array(*[F.min(F.col("lo")[i]) for i in range(k)]).alias("lo"),
            F.array(*[F.max(F.col("hi")[i]) for i in range(k)]).alias("hi"))

    group = F.col("group")
    pairs = leaves.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for level in range(levels - 1, -1, -1):
        box = boxes(F.shiftright(group, FAN_BITS * level), F.shiftright(group, FAN_BITS * (level + 1)))
        left = box.select(*[F.col(c).alias(f"l_{c}") for c in box.columns])
        right = box.select(*[F.col(c).alias(f"r_{c}") for c in box.columns])
        gap = F.aggregate(
            F.arrays_zip("l_lo", "l_hi", "r_lo", "r_hi"), F.lit(0.0),
            lambda acc, x: acc + F.pow(F.greatest(F.lit(0.0), x["r_lo"] - x["l_hi"],
                                                  x["l_lo"] - x["r_hi"]), F.lit(2)))
        pairs = materialize(
            pairs.join(left, F.col("a") == F.col("l_above")).join(
                right, F.col("b") == F.col("r_above")).filter(
                (F.col("l_id") <= F.col("r_id")) & (F.col("l_size") == F.col("r_size"))
                & (gap <= reach2)).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
            .distinct(), "interval-pairs", narrow=True)
    return pairs


def link(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id",
         embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    eps = float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                          F.when(usable(F.col(embedding)), F.col(embedding)).alias("v"))
    classes = materialize(rows.filter("v IS NOT NULL").groupBy("v").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    n, longest = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    axes = fit_axes(classes)
    leaves = leaves_of(classes, axes, eps, n)
    parts = max(1, -(-n // (LEAF * LEAVES_PER_TASK)))
    double = "double" in dict(classes.dtypes)["v"]
    kind = np.float64 if double else np.float32
    part_bytes = LEAF * LEAVES_PER_TASK * (longest or 1) * np.dtype(kind).itemsize
    per_group = max(1, min(-(-parts // GROUPS), GROUP_BYTES // part_bytes))
    leaves = materialize(leaves.withColumn("group", F.floor(F.col("part") / per_group)),
                         "vector-leaves")
    pairs = near_groups(leaves, -(-parts // per_group), eps)
    reach2 = eps * eps * (1 + 1e-9)

    load = leaves.select("group", "leaf", "size", "vectors", "copies")
    sides = pairs.select("a", "b", F.col("a").alias("group"), F.lit(False).alias("right")).union(
        pairs.filter("a < b").select("a", "b", "b", F.lit(True)))
    work = sides.join(load, "group").drop("group").repartition(
        max(shuffle_width(vectors.sparkSession), pairs.count()), "a", "b").sortWithinPartitions(
        "a", "b", "right", "leaf")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit_of_work, held = None, []
        for batch in batches:
            for ga, gb, right, leaf, size, raw, copies in zip(*[batch[c] for c in (
                    "a", "b", "right", "leaf", "size", "vectors", "copies")]):
                if (ga, gb) != unit_of_work:
                    unit_of_work, held = (ga, gb), []
                x = unit(np.frombuffer(raw, kind).reshape(-1, size))
                mine = ((leaf << _LEAF_BITS) + np.arange(len(x)), x, coordinates(x, axes),
                        np.frombuffer(copies, np.int64))
                if not right:
                    held.append(mine)
                if ga < gb and not right:
                    continue
                for other in held:
                    if other[1].shape[1] != size:
                        continue
                    same = other is mine
                    found = join_intervals(other[1], x, other[2], mine[2], threshold, reach2, same)
                    if found:
                        yield summarize(found, other[0], mine[0], other[3], mine[3], same)

    hits = materialize(work.mapInPandas(compare, "node long, links long, to long"), "vector-links")
    labels = connected(hits.filter("node <> to").select(F.col("node").alias("a"),
                                                        F.col("to").alias("b")))

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaf, size, v, reps, named, copies in zip(*[batch[c] for c in (
                    "leaf", "size", "vectors", "reps", "named", "copies")]):
                x = np.frombuffer(v, kind).reshape(-1, size)
                rep = pd.array(np.frombuffer(reps, np.int64).copy(), dtype="Int64")
                rep[~np.frombuffer(named, np.bool_)] = pd.NA
                yield pd.DataFrame({"node": (leaf << _LEAF_BITS) + np.arange(len(x)),
                                    "rep": rep, "copies": np.frombuffer(copies, np.int64),
                                    "v": list(x)})

    element = "double" if double else "float"
    known = leaves.mapInPandas(members, f"node long, rep long, copies long, v array<{element}>")
    counts = hits.groupBy("node").agg(F.sum("links").alias("links"))
    linked = known.join(counts, "node", "left").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    linked = materialize(linked, "vector-members")
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    result = linked.join(least, "label").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id")
    out = rows.join(result, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        .alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"),
                                             F.lit(False)))
