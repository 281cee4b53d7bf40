import random

from pyspark.sql import functions as F
from tests.llm.data import no_documents, odd_documents

from topicpulse.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = {"idiot": 4.0, "moron": 3.0, "scum": 5.0, "worthless": 2.0, "idiotic": 1.5, "ab": 1.0}
    lexicon = T.FuzzyLexicon(terms)
    rnd = random.Random(2)
    words = list(terms)
    for _ in range(5000):
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(w))
            kind = rnd.random()
            if kind < 0.4:
                w.insert(at, rnd.choice("abidoz"))
            elif w and kind < 0.8:
                w[at % len(w)] = rnd.choice("abidoz")
            elif w:
                del w[at % len(w)]
        word = "".join(w)
        near = [(t, distance(word, t)) for t in terms]
        near = [(terms[t] / (1 + d), d) for t, d in near if d <= T.allowed_errors(len(t))]
        got = lexicon.match(word)
        assert got == max(near, key=lambda x: (x[0], -x[1]), default=None), word


def test_quotation_counts_apart():
    reader = T.Reader({"idiot": 3.0})
    abuse = reader.features("you are an idiot and nothing else at all")
    quote = reader.features("he wrote “you are an idiot” and nothing else at all")
    assert abuse[0] > 0 and abuse[2] == 0 and quote[0] == 0 and quote[2] > 0
    assert reader.features("you are an idoit") != reader.features("you are an")
    assert reader.features(None) == reader.features("") == [0.0] * len(T.FEATURES)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = T.score(docs, T.learn(docs, labels)).join(labels, "doc_id").filter(
        T.held_out(F.col("doc_id"))).toPandas()
    toxic = got["toxic"] == 1
    assert (got.loc[toxic, "score"] >= 0.7).mean() > 0.85
    assert (got.loc[~toxic, "score"] >= 0.7).mean() < 0.02


def test_clear_terms_rank_before_frequent_words_that_lean(spark, monkeypatch):
    # one language has more toxic texts, so all its common words lean; each of its
    # toxic texts holds three of thirty terms
    monkeypatch.setattr(T, "MAX_TERMS", 40)
    rnd = random.Random(6)
    terms = [f"vequ{k}x" for k in range(30)]
    rows = []
    for k in range(900):
        lean = k % 3 == 0
        toxic = int(rnd.random() < (0.4 if lean else 0.03))
        words = rnd.choices([f"{'fr' if lean else 'en'}{j}" for j in range(50)], k=60)
        words += rnd.sample(terms if lean else ["idiot", "moron", "scum"], 3) if toxic else []
        rows.append((" ".join(words), toxic, k % 2))
    sample = spark.createDataFrame(rows, "text string, toxic int, fold int")
    learned = list(T.learn_terms(sample)[0])[:30]
    assert len(set(terms) & set(learned)) >= 25
    assert not any(w.startswith("fr") for w in learned)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (3, 0, None), (8, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = T.score(docs, T.learn(docs, given)).collect()
        assert len(got) == docs.count() and all(0 <= r["score_"] <= 1 for r in got)
    empty = no_documents(spark)
    assert T.score(empty, T.learn(empty, labels)).count() == 0


def test_every_proven_term_of_all_labelled_texts(spark, monkeypatch):
    # far more terms than one automaton holds, far more rows than the sample
    monkeypatch.setattr(T, "MAX_TERMS", 40)
    monkeypatch.setattr(T, "ROWS_PER_CLASS", 60)
    rnd = random.Random(9)
    terms = [f"{a}{b}qu{a}zx" for a in "bcdfghjklm" for b in "aeiou"]
    rows = []
    for k in range(2400):
        words = rnd.choices([f"w{j}" for j in range(40)], k=30)
        words += [terms[(k // 3 + j) % len(terms)] for j in (0, 7, 19)] if k % 3 == 0 else []
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 AS int) AS toxic")
    model = T.learn(docs, labels)
    assert set(terms) <= set(model.terms)
    assert not any(w.startswith("w") for w in model.terms)
    reader, one = T.Reader(model.terms), T.FuzzyLexicon(model.terms)
    for w in terms + [t[:3] + t[4:] for t in terms] + ["river"]:
        assert reader.match(w) == one.match(w)
