import numpy as np
import pytest

from topicpulse.llm import components
from topicpulse.llm import embeddings as E


def brute(ids, vectors, threshold):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
          and any(x != 0 for x in v) for v in vectors]
    unit = [E.unit(np.array([v], dtype=float))[0] if o else None for v, o in zip(vectors, ok)]
    links = [0] * n
    label = list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if ok[i] and ok[j]
             and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            least = min(label[i], label[j])
            if label[i] != least or label[j] != least:
                label[i] = label[j] = least
                changed = True
    out = []
    for i in range(n):
        named = [ids[j] for j in range(n) if label[j] == label[i] and ids[j] is not None]
        out.append((ids[i], links[i], min(named, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind,leaf,groups", [("float", 2048, 12), ("double", 40, 12),
                                              ("float", 20, 3), ("double", 40, 1)])
def test_against_all_pairs(spark, monkeypatch, kind, leaf, groups):
    monkeypatch.setattr(E, "LEAF", leaf)
    monkeypatch.setattr(E, "GROUPS", groups)
    monkeypatch.setattr(E, "PIECE", 8)
    monkeypatch.setattr(E, "FAN_BITS", 1)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 16))
    x = centers[rng.integers(0, 12, 400)] + 0.16 * rng.standard_normal((400, 16))
    x[50:90] = x[50]
    x[90:110] = 3 * x[90:91]
    vectors = [v.astype(np.float32 if kind == "float" else float).tolist() for v in x]
    vectors += [[1.0, 0.0], [1.0, 0.01], [2.0, 0.0, 0.0], [-1.0, 0.0]]
    ids = [int(k) for k in rng.permutation(len(vectors))]
    df = spark.createDataFrame(list(zip(ids, vectors)), f"vec_id long, embedding array<{kind}>")
    got = sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in E.link(df).collect()],
                 key=str)
    assert got == brute(ids, vectors, 0.95)


def test_a_dense_group_and_small_groups_of_leaves(spark, monkeypatch):
    """Half of all vectors link with each other; a byte bound of one part a group."""
    monkeypatch.setattr(E, "LEAF", 16)
    monkeypatch.setattr(E, "PIECE", 4)
    monkeypatch.setattr(E, "GROUP_BYTES", 1)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    x[:150] = x[0] + 0.02 * rng.standard_normal((150, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)],
                               "vec_id long, embedding array<double>")
    got = sorted([tuple(r)[:3] for r in E.link(df).collect()], key=str)
    assert got == brute(list(range(300)), x.tolist(), 0.95)


def test_far_groups_are_skipped(spark):
    """Groups of leaves on well separated directions meet only their neighbours."""
    lo = [[float(g)] * 9 for g in range(40)]
    leaves = spark.createDataFrame([(g, 4, v, v) for g, v in enumerate(lo)],
                                   "group long, size int, lo array<double>, hi array<double>")
    got = {tuple(r) for r in E.near_groups(leaves, 40, 3.5).collect()}
    assert got == {(g, h) for g in range(40) for h in (g, g + 1) if h < 40}


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1e300, 1e290]), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [1.0, None]), (7, [inf, 1.0]), (8, [nan, 1.0]), (None, [1.0, 0.001]), (None, [0.0, 1.0]),
            (9, [1e-320, 0.0])]
    df = spark.createDataFrame([(a, b, "mine", "mine") for a, b in rows],
                               "vec_id long, embedding array<double>, node string, label string")
    got = E.link(df).collect()
    want = brute([r[0] for r in rows], [r[1] for r in rows], 0.95)
    assert sorted([tuple(r)[:3] for r in got], key=str) == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert E.link(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected(df).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000)}
    assert components.connected(df.limit(0)).count() == 0
