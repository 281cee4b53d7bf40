import random
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.data import no_documents, odd_documents

from topicpulse.llm import sharding
from topicpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
def dims():
    return {"length": F.log2(F.octet_length("text") + 1),
            "lang": F.crc32(F.col("lang").cast("binary"))}


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sums = defaultdict(int)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["law"] == "bytes" and r["grown_shard"] is None
        sums[r["shard"]] += r["size"]
    check_slots(rows)
    largest = max(len(t.encode()) for t in texts.values())
    assert set(sums) == set(range(8)) and max(sums.values()) - min(sums.values()) <= largest


def test_one_text_with_a_third_of_the_rows(spark):
    df = spark.range(9000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('same ', 40) "
        "ELSE repeat(concat('x', id), 1 + CAST(id % 17 AS INT)) END AS text", "'en' AS lang")
    rows = sharding.shard_documents(df, 8, dims()).collect()
    sums = defaultdict(int)
    homes = defaultdict(set)
    for r in rows:
        sums[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
    assert max(sums.values()) < 1.01 * min(sums.values())
    check_slots(rows)
    # copies stay together but for the cuts that must go through them
    assert len(homes[zlib.crc32(b"same " * 40)]) <= 7


def test_other_counts_and_ties(spark):
    for shards, n in ((1, 10), (3, 900), (5, 1000), (8, 3)):
        df = spark.range(n).selectExpr("id % 7 AS doc_id", "'tie' AS text", "'en' AS lang")
        rows = sharding.shard_documents(df, shards, dims()).collect()
        assert len(rows) == n and {r["shard"] for r in rows} <= set(range(shards))
        check_slots(rows)
        if n > 100:
            counts = [sum(r["shard"] == s for r in rows) for s in range(shards)]
            assert max(counts) - min(counts) <= 0.02 * n


def widest(rows, names, scale):
    """The dimension whose byte-weighted variance over its whole range is largest."""
    total = sum(r["size"] for r in rows)

    def spread(d):
        mean = sum(r["size"] * r[d] for r in rows) / total
        return sum(r["size"] * (r[d] - mean) ** 2 for r in rows) / total / scale[d] ** 2

    return max(names, key=spread)


def follow(rows, names, scale, first, shards):
    """Asserts, cut by cut, that the shards are the leaves of the k-d tree."""
    if shards < 2 or not rows:
        return
    half = shards // 2
    left = [r for r in rows if r["shard"] < first + half]
    right = [r for r in rows if r["shard"] >= first + half]
    d = widest(rows, names, scale)

    def key(r):
        return r[d], r["text_key"]

    assert max(map(key, left)) <= min(map(key, right))
    total = sum(r["size"] for r in rows)
    # no row next to the cut would bring the left side nearer to its share
    off = sum(r["size"] for r in left) - total * half / shards
    step = max(max(left, key=key)["size"], min(right, key=key)["size"])
    assert abs(off) <= max(step, sharding.TOLERANCE * total), (first, shards, d)
    follow(left, names, scale, first, half)
    follow(right, names, scale, first + half, shards - half)


@pytest.mark.parametrize("shards,seed", [(8, 1), (5, 2), (2, 3)])
def test_shards_are_leaves_of_a_brute_force_tree(spark, shards, seed):
    rnd = random.Random(seed)
    made = {}
    for k in range(700):
        text = f"{k} " + "x" * int(rnd.paretovariate(0.8) * 5 % 3000)
        made[k] = {"text": text, "a": rnd.gauss(0, 1), "b": rnd.random() ** 3 * 50,
                   "c": float(rnd.randrange(3)), "size": len(text) + 1,
                   "text_key": xxhash.xxh64_intdigest(text.encode(), seed=42) >> 12}
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(k, m["text"], m["a"], m["b"], m["c"]) for k, m in made.items()],
                               "doc_id long, text string, a double, b double, c double")
    for r in sharding.shard_documents(df, shards, {n: F.col(n) for n in names}).collect():
        made[r["row"]["doc_id"]]["shard"] = r["shard"]
    rows = list(made.values())
    scale = {n: max(r[n] for r in rows) - min(r[n] for r in rows) for n in names}
    follow(rows, names, scale, 0, shards)


def test_values_that_are_no_numbers(spark):
    odd = ["nan", "inf", "-inf", None, "-3.5", "0"]
    df = spark.range(600).selectExpr(
        "id AS doc_id", "concat('t', id) AS text",
        "CAST(element_at(array(" + ", ".join("NULL" if o is None else f"'{o}'" for o in odd)
        + "), CAST(id % 6 AS INT) + 1) AS DOUBLE) AS d")
    rows = sharding.shard_documents(df, 4, {"d": F.col("d")}).collect()
    check_slots(rows)
    counts = [sum(r["shard"] == s for r in rows) for s in range(4)]
    assert sum(counts) == 600 and max(counts) - min(counts) <= 12
    low = {r["row"]["doc_id"] % 6 for r in rows if r["shard"] == 0}
    assert 4 in low


def test_a_very_long_text(spark):
    df = spark.range(200).selectExpr("id AS doc_id", "IF(id = 7, repeat('long ', 400000), 'short') AS text",
                                     "'en' AS lang")
    rows = sharding.shard_documents(df, 4, dims()).collect()
    check_slots(rows)
    assert len(rows) == 200 and [r["size"] for r in rows if r["row"]["doc_id"] == 7] == [2_000_001]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = sharding.shard_documents(docs, 4, dims()).collect()
    assert len(rows) == docs.count() and rows[0]["row"]["shard"] == "mine"
    check_slots(rows)
    assert {r["size"] for r in rows if r["row"]["doc_id"] in (3, 4)} == {1}
    empty = sharding.shard_documents(no_documents(spark), 8, dims())
    assert empty.count() == 0 and "grown_shard" in empty.columns
