import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm.data import no_documents, odd_documents

from topicpulse.llm import quality
from topicpulse.llm.common import materialize
from topicpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered)]


def cdf(k, n, p):
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def test_measures_equal_brute_force(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["a", "b", "c", "##", "|", "é"], k=rnd.randint(0, 40)))
             for _ in range(150)]
    texts += ["\n".join(rnd.choices(["x y", " ", "", "z\t", "x y"], k=9)) for _ in range(50)]
    texts += ["a a a a", "a b c a b c", " \x0b\x0c ", "\U0001f600 # \U0001f600"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.with_measures(df).select("row.doc_id", "measures.*").collect():
        assert [r[n] for n in NAMES] == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


@pytest.mark.parametrize("n,p", [(20, 0.1), (400, 0.02), (3000, 0.005)])
def test_binomial_bound(spark, n, p):
    ks = [k for k in range(0, min(n, 40)) if k < n * p]
    df = spark.createDataFrame([(k, n) for k in ks], "k long, n long")
    for r in df.select("k", quality.binomial_cdf(F.col("k"), F.col("n"), p).alias("c")).collect():
        assert abs(r["c"] - cdf(r["k"], n, p)) < 1e-9


def made(spark, symbols):
    """Measured rows of which row i has the symbol ratio symbols[i] and a text of its own."""
    rows = [(i, "en", s) for i, s in enumerate(symbols)]
    return spark.createDataFrame(rows, "doc_id long, lang string, s long").select(
        F.struct("doc_id", "lang").alias("row"), F.md5(F.col("doc_id").cast("string")).alias("digest"),
        F.struct(F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"),
                 (F.col("s") * 100).alias("n_symbols"), F.lit(9).cast("long").alias("n_lines"),
                 F.lit(0).cast("long").alias("n_dup_lines"),
                 F.lit(0).cast("long").alias("n_repeat_words")).alias("measures"))


def test_cutoffs_keep_their_promise(spark):
    # the symbol ratio of 8 is high in 8 texts; one of 1 in 80 more, which is over the risk
    measured = made(spark, [8 if i < 8 else 1 if i < 88 else 0 for i in range(4000)])
    labels = measured.select("row.doc_id", F.lit(1).alias("quality"))
    assert cdf(8, 4000, quality.RISK) <= quality.DELTA < cdf(88, 4000, quality.RISK)
    cutoffs = quality.learn_cutoffs(measured, labels, "lang")
    cut = cutoffs.collect()[0]
    # the ladder stops where the symbol ratio 1 would be rejected
    assert cut["n"] == 4000 and quality.STEPS[cut["steps"]] == ("symbol_ratio", 0.7)
    assert (cut["symbol_ratio"], cut["dup_line_ratio"], cut["chars_per_word"]) == (1.0, 0.5, 15.0)
    kept = quality.judge(measured, cutoffs, "lang")
    assert kept.filter("NOT kept").count() == 8
    none = quality.learn_cutoffs(measured, labels.limit(50), "lang").collect()[0]
    assert none["steps"] == 0 and none["symbol_ratio"] is None


def test_rules_share_one_risk(spark):
    # 30 good texts go to the symbol rule and 30 others to the line rule: 1.5 % each, 3 % together
    measured = made(spark, [8 if i < 30 else 0 for i in range(2000)])
    lines = F.when(F.col("row.doc_id").between(30, 59), 9).otherwise(0).cast("long")
    measured = measured.withColumn("measures", F.col("measures").withField("n_dup_lines", lines))
    labels = measured.select("row.doc_id", F.lit(1).alias("quality"))
    cut = quality.learn_cutoffs(measured, labels, "lang", risk=0.025).collect()[0]
    assert cut["steps"] == 1 and cut["symbol_ratio"] == 4.0 and cut["dup_line_ratio"] is None


def test_copies_and_repeated_labels_prove_nothing(spark):
    measured = made(spark, [0] * 100)
    labels = measured.select("row.doc_id", F.lit(1).alias("quality"))
    labels = labels.crossJoin(spark.range(30))
    cut = quality.learn_cutoffs(measured, labels, "lang").collect()[0]
    assert cut["n"] == 100 and cut["steps"] == 0
    copies = made(spark, [0] * 3200).withColumn("digest", F.md5((F.col("row.doc_id") % 100).cast("string")))
    labels = copies.select("row.doc_id", F.lit(1).alias("quality"))
    assert quality.learn_cutoffs(copies, labels, "lang").collect()[0]["n"] == 100


def test_query_uses_proven_cutoffs(spark):
    """At sf0.1 every language has good texts enough to prove cutoffs."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    measured = materialize(quality.with_measures(docs), "test-measures")
    cut = quality.learn_cutoffs(measured, labels, "lang").collect()
    assert sum(r["steps"] > 0 for r in cut if r["stratum"]) >= 4, cut


def test_query_and_good_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op8_quality"](spark, SF).collect()
    assert len(got) == len(docs)
    lost = 0
    for r in got:
        m = brute(docs[r["doc_id"]]["text"])
        assert [r[n] for n in NAMES] == m
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r["kept"] and r["base_failed"])
        lost += labels.get(r["doc_id"]) == 1 and not r["kept"] and not r["base_failed"]
    assert lost <= quality.RISK * sum(v == 1 for v in labels.values())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.assess(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        if not r["row"]["doc_id"] or r["row"]["doc_id"] in (3, 4, 5):
            assert not r["kept"]
        assert r["row"]["kept"] == "mine"
    assert quality.assess(no_documents(spark), labels).count() == 0


def test_every_stratum_is_tested(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"l{k}", text) for k in range(1100)],
                                 "doc_id long, lang string, text string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    cutoffs = quality.learn_cutoffs(quality.with_measures(docs, "text"), labels, "lang")
    assert cutoffs.count() == 1100
