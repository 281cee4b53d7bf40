import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm.data import no_documents, odd_documents

from topicpulse.llm import collocations as C


def brute(rows, min_count, top=2000):
    """The contract in plain Python; rows: (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = {}
    for (lang, *w), a in cands.items():
        cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        held = any(100 * b >= 80 * a and other[0] == lang and len(other) - 1 > len(w)
                   and any(list(other[1 + i:1 + i + len(w)]) == w
                           for i in range(len(other) - len(w)))
                   for other, b in cands.items())
        if not held:
            out.setdefault(lang, []).append(
                (-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -score)
            for lang, rows in out.items()
            for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def mined(df, **kw):
    return {tuple(r) for r in C.mine(df, **kw).collect()}


def texts(seed, count):
    rnd = random.Random(seed)
    words = ["a", "B", "c", "été", "Été", "x1", "of", "the", " ", "y z", "\x1f"]
    seps = [" ", "  ", "\t", ". ", ",", "\n", " \r\n", "; "]
    return [("".join(rnd.choice(words) + rnd.choice(seps if rnd.random() < 0.3 else [" "])
                     for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "fr", None]))
            for _ in range(count)]


@pytest.mark.parametrize("slice_size", [64, 4 << 20])
def test_equals_brute_force(spark, monkeypatch, slice_size):
    monkeypatch.setattr(C, "SLICE", slice_size)
    rows = texts(5, 250) + [("to be or not. to be or not", "en")] * 20 + [("", "en"), (None, "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = brute(rows, 12)
    assert len(want) > 100
    assert mined(df, min_count=12) == want


def test_top_and_ties(spark):
    rows = [(f"{a} {b}", "en") for a, b in ["pq", "ba", "zz", "ab"] for _ in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert mined(df, top=2) == brute(rows, 30, top=2)
    assert [r["phrase"] for r in C.mine(df).orderBy("rank").collect()][:1] == ["p q"]


def test_scores_past_64_bits(spark):
    big = 3 * 10 ** 17
    rows = [("en", ["a", "b"], "a b", big), ("en", ["a"], "a", big + 1), ("en", ["b"], "b", big + 2)]
    df = spark.createDataFrame(rows, "lang string, words array<string>, phrase string, f long")
    assert C.scored(df).first()["score"] == 2000000 * big // (2 * big + 3)


def test_a_bucket_shared_by_all_pairs_changes_nothing(spark, monkeypatch):
    rows = texts(9, 120)
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(C, "run_buckets", lambda hashes, size: (hashes[size - 1:] * 0).astype("int64"))
    assert mined(df, min_count=8) == brute(rows, 8)


def test_odd_rows_and_empty_table(spark):
    df = odd_documents(spark)
    rows = [(r["text"], r["lang"]) for r in df.select("text", "lang").collect()]
    assert mined(df) == brute(rows, 30)
    assert mined(no_documents(spark)) == set()


def test_a_third_of_all_rows_alike(spark):
    rows = texts(2, 100) + [("one copied line. and its end", "en")] * 50
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit("mine"))
    assert mined(df, min_count=20) == brute(rows, 20)
