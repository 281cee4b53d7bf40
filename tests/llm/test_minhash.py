import random
from collections import defaultdict

import numpy as np
from tests.llm.data import no_documents, odd_documents

from topicpulse.llm import minhash as M
from topicpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(texts, idf):
    """Class (least index) of each text, comparing all pairs."""
    words = M.Words()
    sets = []
    for t in texts:
        h, tf = M.shingles(words, t)
        sets.append((h, tf * idf[(h >> np.uint64(48)).astype(int)]))
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and find(i) != find(j) \
                    and M.weighted_jaccard(sets[i], sets[j]) >= M.THRESHOLD:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rnd, words, share):
    return [w if rnd.random() > share else f"w{rnd.randint(0, 10**6)}" for w in words]


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(0)
    sampler = M.Sampler(np.ones(M.DF_BUCKETS))
    got, want = [], []
    for _ in range(60):
        h = np.unique(M.mix(rng.integers(0, 2**63, 300).astype(np.uint64)))
        tf = rng.integers(1, 4, len(h))
        other = tf.copy()
        other[:rng.integers(0, 150)] += 2
        a, b = sampler.samples(h, tf), sampler.samples(h, other)
        got.append((a == b).mean())
        want.append(M.weighted_jaccard((h, tf.astype(float)), (h, other.astype(float))))
    assert abs(np.mean(got) - np.mean(want)) < 0.02
    assert np.abs(np.array(got) - want).max() < 0.2


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    ids = [r["doc_id"] for r in rows]
    root = brute([r["text"] for r in rows], M.learn_idf(docs))
    got = {r["doc_id"]: r for r in QUERIES["op4_minhash"](spark, SF).collect()}
    assert {d: got[d]["class_id"] for d in ids} == {d: ids[k] for d, k in zip(ids, root)}
    assert {d for d in ids if got[d]["kept"]} == {ids[k] for k in root}
    assert sorted(r["doc_id"] for r in M.deduplicate(docs).collect()) == sorted({ids[k] for k in root})


def test_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rnd = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    texts = [" ".join(base)] + [" ".join(edited(rnd, base, rnd.choice([0.01, 0.02, 0.05])))
                                for _ in range(90)]
    texts += [" ".join(f"u{k}-{j}" for j in range(60)) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = brute(texts, M.learn_idf(df))
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == root


def test_rows_grow_with_the_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    read, per_unit = [], M.per_unit

    def counted(rows, *args):
        read.append(rows.count())
        return per_unit(rows, *args)

    monkeypatch.setattr(M, "per_unit", counted)
    rnd = random.Random(4)
    base = [f"b{k}" for k in range(300)]
    for n in (100, 400):
        texts = [" ".join([*base[:(at := rnd.randrange(300))], f"w{k}", *base[at:]])
                 for k in range(n)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        read.clear()
        assert {r["class_id"] for r in M.near_duplicates(df).collect()} == {0}
        # a text is once in each of its bands, once in its group, and roots are fewer
        assert n <= sum(read) <= 1.5 * (M.BANDS + 1) * n


def test_members_that_no_root_speaks_for(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rnd = random.Random(12)
    texts = []
    for k in range(5):
        # drifting copies: neighbours are near duplicates, distant ones are not
        words = [f"{k}-{j}" for j in range(100)]
        for _ in range(30):
            texts.append(" ".join(words))
            words[rnd.randrange(100)] = f"n{rnd.randrange(10**6)}"
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = brute(texts, M.learn_idf(df))
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == root


def test_units_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(M, "UNIT_BYTES", 3000)
    rnd = random.Random(6)
    base = [f"b{k}" for k in range(150)]
    texts = [" ".join(edited(rnd, base, 0.02)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, M.learn_idf(df))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = M.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    classes = defaultdict(list)
    for r in rows:
        classes[r["class_id"]].append((r["doc_id"], r["kept"]))
    assert sorted(classes[1], key=str) == sorted(
        [(1, True), (1, False), (2, False), (None, False)], key=str)
    assert classes[8] == [(8, True), (9, False)] or classes[8] == [(9, False), (8, True)]
    assert all(classes[k] == [(k, True)] for k in (3, 4, 5, 6, 7, 10, 11))
    kept = M.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 10, 11]
    assert M.near_duplicates(no_documents(spark)).count() == 0
    assert M.deduplicate(no_documents(spark)).count() == 0


def test_classes_of_one_name_keep_one_row_each(spark):
    def text(name):
        return " ".join(f"{name}{k}" for k in range(30))

    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (None, ""),
            (5, text("c")), (5, text("d")), (6, text("d")), (7, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = M.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in marked), key=str) == sorted(
        [(None, None, True)] * 3 + [(None, None, False), (5, 5, True), (5, 5, True),
                                    (6, 5, False), (7, 7, True)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in M.deduplicate(docs).collect()]
    assert sorted(kept, key=str) == sorted(
        [rows[k] for k in (0, 2, 3, 4, 5, 7)], key=str)
