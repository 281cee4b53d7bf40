import random
import re
import time

import pytest
from tests.llm.data import SF0001, no_documents, odd_documents

from topicpulse.llm import licenses as L
from topicpulse.llm.queries import QUERIES


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in L.BASE_PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in places})))


def test_random_texts_equal_brute_force():
    automaton = L.WordAutomaton(dict.fromkeys([*L.BASE_PHRASES, *L.MORE_PHRASES, L.TAG], ""))
    rnd = random.Random(5)
    parts = ["gnu", "GNU", "general", "public", "License", "lesser", "apache", "cc", "by", "MIT",
             "x", "é", "K", "0"]
    for _ in range(3000):
        text = rnd.choice([" ", "-", "\n", ", "]).join(rnd.choices(parts, k=rnd.randint(0, 25)))
        assert L.scan_text(automaton, text)[:5] == brute(text)


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    for r in QUERIES["op5_licenses"](spark, SF0001).collect():
        assert tuple(r)[1:6] == brute(texts[r["doc_id"]])
        base, labels = (set(filter(None, r[c].split(","))) for c in ("base_labels", "labels"))
        assert 0 <= r["score"] <= 1 and base <= labels


@pytest.mark.parametrize("text,labels,score", [
    ("MIT", {"mit"}, 0.1),
    ("MIT OR GPL-3.0-only", {"mit", "gpl"}, 0.1),
    ("MIT AND GPL-3.0-only", {"mit", "gpl"}, 0.8),
    ("MIT OR Apache-2.0 AND GPL-2.0", {"mit", "apache", "gpl"}, 0.1),
    ("(MIT OR Apache-2.0) AND GPL-2.0", {"mit", "apache", "gpl"}, 0.8),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", {"gpl"}, 0.4),
    ("MIT OR", {"mit"}, 0.1),
    ("((MIT", set(), 0.0),
    ("", set(), 0.0),
    ("Some-Own", {"some-own"}, 0.5),
    ("MIT WITH (ISC OR BSD-3-Clause) AND Apache-2.0", {"mit", "apache"}, 0.2),
    ("(MIT OR (GPL-2.0 WITH x AND ISC)) OR EPL-2.0 AND (", {"mit", "gpl", "isc", "epl"}, 0.1),
])
def test_expressions(text, labels, score):
    assert L.evaluate(text) == (labels, score)


def test_tag_in_a_document(spark):
    text = "// SPDX-License-Identifier: MIT OR GPL-2.0\nReleased under the Apache License, v2"
    df = spark.createDataFrame([(1, text, "mine")], "doc_id long, text string, license string")
    r = L.scan_licenses(df).collect()[0]
    assert r["license"] == "mine" and r["license_"]["labels"] == "apache,gpl,mit"
    assert r["license_"]["base_labels"] == "apache" and r["license_"]["n_base"] == 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = L.scan_licenses(docs).collect()
    assert len(got) == docs.count()
    assert all(tuple(r["license_"])[:5] == brute(r["text"]) for r in got)
    assert L.scan_licenses(no_documents(spark)).count() == 0


@pytest.mark.parametrize("text,labels,score", [
    ("<!-- SPDX-License-Identifier: (GPL-2.0 OR MIT) -->", "gpl,mit", 0.1),
    ("SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause) in this file",
     "apache,bsd,mit", 0.1),
    ("/* SPDX-License-Identifier: GPL-2.0 OR MIT */ or later", "gpl,mit", 0.1),
    ("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0", "gpl,mit", 0.8),
    ("é SPDX License Identifier: MIT AND\nSPDX-License-Identifier:ISC", "isc,mit", 0.1),
    ("| SPDX License Identifier | EPL-2.0 |", "epl", 0.5),
    ('"SPDX-License-Identifier": "MPL-2.0"', "mpl", 0.5),
    ("the SPDX license identifier of a file names its terms", "", 0.0),
])
def test_expressions_end_with_their_grammar(text, labels, score):
    automaton = L.WordAutomaton(dict.fromkeys([*L.BASE_PHRASES, *L.MORE_PHRASES, L.TAG], ""))
    assert L.scan_text(automaton, text)[5:] == (labels, score)


@pytest.mark.parametrize("joined", [" OR ", " AND ", " WITH ", " OR ("])
def test_time_grows_with_the_expression_alone(joined):
    n = 100_000
    text = joined.join(f"Own-{k}" for k in range(n)) + ")" * (n - 1 if "(" in joined else 0)
    started = time.process_time()
    names, weight = L.evaluate(text)
    assert time.process_time() - started < 5
    assert len(names) == (1 if "WITH" in joined else n)
    assert weight == (0.0 if "WITH" in joined else 0.5)
